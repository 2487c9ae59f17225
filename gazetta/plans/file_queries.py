"""Registered queries of the operators that read and write files, requests, answers and jobs.

Each writes a projection of whole tables in the format in question into the shared folder and reads it back through the
operator; the SQL gives the rows from the tables themselves.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import json_text, text
from ..operators import coords, cost, jobs, prep, profile, resolve, results
from ..session import new_path
from ..sources import readers, writers
from ..streaming import batches, calls, state
from .queries import _t, query


def _local(path: str) -> str:
    """For the few files that the driver keeps for its user."""
    path = "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
    os.makedirs(path, exist_ok=True)
    return path


# --- tables and records ----------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ' \"q\", ' || chr(10) || 'x' AS note, ',' AS delimiter FROM customer")
def delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, separators and line breaks in fields, BOM."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias(S.ROW), F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(' "q", \nx')).alias("note"))
    path = writers.export_delimited(rows, f"{new_path(spark, 'delimited')}/t.csv")
    return readers.read_delimited(spark, path).select("id", "note", F.lit(readers.detect_delimiter(spark, path)).alias("delimiter"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def delimited_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinal of the reader is the order of the file."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(S.ROW), "o_orderkey")
    path = writers.export_delimited(rows, f"{new_path(spark, 'ordered')}/t.tsv")
    return jobs.ordinals(readers.read_delimited(spark, path), [S.ROW]).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), (F.col("__n") + 1).alias("place"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 160 - 80 AS DOUBLE) END AS latitude, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS note FROM customer")
def progress_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks are null, number columns numbers where they parse."""
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 == 0, "x").otherwise((k % 160 - 80).cast("string")).alias("Latitude"), F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")).alias("Note"))
    path = f"{new_path(spark, 'progress')}/t.tsv"
    writers.write_delimited(rows, path)
    return readers.read_progress(spark, path).select("id", F.col("Latitude").alias("latitude"), F.col("Note").alias("note"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of records with nulls."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    return readers.load_records(spark, writers.export_json(rows, f"{new_path(spark, 'records')}/t.json")).select("id", "name", "segment")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ' {"a}' || chr(10) || ']' AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS inner_segment, row_number() OVER (ORDER BY c_custkey) AS place FROM customer""")
def split_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list cut into records by many tasks; brackets and quotes in texts, records within records, order kept."""
    inner = F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias(S.ROW), F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(' {"a}\n]')).alias("name"), F.array(inner).alias("list"))
    found = readers.read_json_records(spark, writers.export_json(rows, f"{new_path(spark, 'lists')}/t.json"), split=True)
    placed = jobs.ordinals(found, [S.ROW])
    return placed.select("id", "name", F.col("list")[0]["segment"].alias("inner_segment"), (F.col("__n") + 1).alias("place"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 160 - 80 AS DOUBLE) AS latitude, CAST(c_custkey % 340 - 170 AS DOUBLE) AS longitude FROM customer WHERE c_custkey % 6 <> 0")
def geojson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points come back as coordinates; rows without numbers are no features."""
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, "?").otherwise((k % 160 - 80).cast("string")).alias("Latitude"), (k % 340 - 170).cast("string").alias("Longitude"))
    found = readers.load_records(spark, writers.export_geojson(rows, f"{new_path(spark, 'points')}/t.geojson"))
    return found.select("id", F.col("Latitude").cast("double").alias("latitude"), F.col("Longitude").cast("double").alias("longitude"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: nulls are written."""
    path, rows = new_path(spark, "lines"), _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("s_acctbal"))
    writers.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT 'csv' AS format, count(*) AS records FROM supplier UNION ALL SELECT 'tsv', count(*) FROM supplier UNION ALL SELECT 'json', count(*) FROM supplier UNION ALL SELECT 'geojson', count(*) FROM supplier UNION ALL SELECT 'xls', 0")
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats at once; unknown ones are named."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("Barcode"), F.lit("1").alias("Latitude"), F.lit("2").alias("Longitude"))
    written, unknown = writers.export_all(rows, f"{new_path(spark, 'all')}/v1.2", ["csv", "tsv", "json", "geojson", "xls"])
    counts = [readers.load_records(spark, p).agg(F.lit(p.rsplit(".", 1)[1]).alias("format"), F.count("*").alias("records")) for p in written]
    return jobs.combine([*counts, spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', 0L)" for u in unknown) + " AS t(format, records)")])


@query("""SELECT 'customers.csv' AS filename, ',' AS delimiter, count(*) AS row_count, true AS has_locality, true AS has_barcode FROM customer
  UNION ALL SELECT 'suppliers.tsv', chr(9), count(*), false, false FROM supplier""")
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty files are left out."""
    folder = new_path(spark, "datasets")
    writers.export_delimited(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Barcode"), F.col("c_name").alias("locality")), f"{folder}/customers.csv")
    writers.export_delimited(_t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), f"{folder}/suppliers.tsv")
    writers.joined_files(spark, _empty(spark), f"{folder}/none.txt", b"")
    return readers.discover_datasets(spark, folder).select("filename", "delimiter", "row_count", "has_locality", "has_barcode")


def _empty(spark: SparkSession) -> str:
    path = new_path(spark, "empty")
    spark.sql("SELECT '' AS value").limit(0).write.text(path)
    return path


@query("SELECT unnest(['a.csv', 'e.json', 'deep.tsv']) AS name")
def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No progress files, read-mes, GeoJSON, job folders or empty files."""
    folder = new_path(spark, "outputs")
    for name in ("a.csv", "a_progress.tsv", "README.txt", "batch_jobs/c.json", "d.geojson", "e.json", "run/deep.tsv"):
        writers.joined_files(spark, _empty(spark), f"{folder}/{name}", b"x\n")
    writers.joined_files(spark, _empty(spark), f"{folder}/nothing.csv", b"")
    return readers.discover_outputs(spark, folder).select("name")


@query("""SELECT 'o/20240102_set_gpt5mini/set_gpt5mini_20240102_030405.tsv' AS dated, '/x/a.b_candidates.tsv' AS candidates, '/x/a.b_georeferenced.tsv' AS expanded, 'v1.2.csv' AS extended""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K15, K16, K18."""
    names = (writers.dated_output("o", "/d/set.csv", "GPT 5.mini", datetime(2024, 1, 2, 3, 4, 5)), writers.default_candidates("/x/a.b.tsv"), writers.default_expanded("/x/a.b.csv"), writers.with_extension("v1.2", ".csv"))
    return spark.createDataFrame([names], "dated string, candidates string, expanded string, extended string")


@query("""SELECT * FROM (VALUES ('Locality verbatim', true, false), ('occurrenceID', false, true), ('my_location', true, false), ('BARCODE 2', false, true), ('name', false, false), ('gridref', false, false), ('catalogNumber', false, true)) t(name, locality, identifier)""")
def column_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6."""
    names = ["Locality verbatim", "occurrenceID", "my_location", "BARCODE 2", "name", "gridref", "catalogNumber"]
    return spark.createDataFrame([(n, resolve.has_locality_column([n]), resolve.has_identifier_column([n])) for n in names], "name string, locality boolean, identifier boolean")


# --- answers ---------------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", '"k"', '"latitude"').alias("answer"))


@query("""SELECT CAST(event_id AS VARCHAR) AS barcode, event_id % 4 <> 0 AS success, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS latitude,
  CASE event_id % 8 WHEN 0 THEN 'expired' WHEN 4 THEN 'too long' END AS error FROM events""")
def message_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of a message-style provider, fenced; other outcomes by type or message."""
    n = F.col("event_id")
    content = F.struct(F.array(F.struct(F.concat(F.lit("```json\n"), "answer", F.lit("\n```")).alias("text"))).alias("content"))
    good = F.to_json(F.struct(n.cast("string").alias("custom_id"), F.struct(F.lit("succeeded").alias("type"), content.alias("message")).alias("result")))
    late = F.to_json(F.struct(n.cast("string").alias("custom_id"), F.struct(F.lit("expired").alias("type")).alias("result")))
    bad = F.to_json(F.struct(n.cast("string").alias("custom_id"), F.struct(F.lit("errored").alias("type"), F.struct(F.lit("too long").alias("message")).alias("error")).alias("result")))
    lines = _answers(spark, sf_dir).select(F.when(n % 8 == 0, late).when(n % 8 == 4, bad).otherwise(good).alias("value"))
    return results.message_results(lines).select("barcode", "success", "latitude", "error")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS latitude, true AS success FROM events")
def odd_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that holds an object, wherever it lies."""
    answer = F.to_json(F.struct(F.col("answer").alias("text")))
    line = F.concat(F.lit('{"key":"'), "event_id", F.lit('","outer":{"inner":[{"text":"none"},{"deeper":['), answer, F.lit(']}]}}'))
    return results.keyed_results(_answers(spark, sf_dir).select(line.alias("value"))).select(F.col("barcode").cast("long").alias("event_id"), "latitude", "success")


@query("SELECT '0' AS barcode, CAST(json_extract(props, '$.k') AS DOUBLE) AS latitude, NULL AS error FROM events UNION ALL SELECT '1', NULL, 'finishReason=SAFETY' FROM events")
def inlined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without keys; the place in the list is the key."""
    answer = F.to_json(F.struct(F.col("answer").alias("text")))
    payload = F.concat(F.lit('{"inlinedResponses":[{"candidates":[{"content":{"parts":['), answer, F.lit(']}}]},{"candidates":[{"finishReason":"SAFETY"}]}]}'))
    return results.inlined_results(_answers(spark, sf_dir).select(payload.alias("value"))).select("barcode", "latitude", "error")


@query("SELECT '{\"custom_id\":\"' || event_id || '\"}' AS value FROM events")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines under a folder."""
    path = new_path(spark, "results")
    writers.write_requests(_t(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"))).alias("value")), path)
    return results.read_lines(spark, path)


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS succeeded, count(*) FILTER (event_id % 3 = 0) AS failed FROM events")
def success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the results of a batch."""
    n = F.col("event_id")
    body = F.struct(F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices"))
    lines = _answers(spark, sf_dir).select(F.to_json(F.struct(n.cast("string").alias("custom_id"), F.struct(F.when(n % 3 == 0, 429).otherwise(200).alias("status_code"), body.alias("body")).alias("response"))).alias("value"))
    return results.success_counts(results.chat_results(lines))


@query("SELECT count(*) AS fetched, count(*) / 50000.0 AS rate FROM events")
def fetched_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return results.fetched_rate(_t(spark, sf_dir, "events"), 50_000).withColumn("rate", F.col("rate").cast("double"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brace that starts no object goes before the one that is meant."""
    found = json_text.rescan_objects(F.concat(F.lit("use {braces}, then "), "props", F.lit(" and } more")))
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("double").alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || event_type WHEN 1 THEN event_type ELSE '' END AS candidate FROM events")
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are joined; a content that is a list counts too; no candidate, no text."""
    n, part = F.col("event_id") % 3, F.struct(F.col("event_type").alias("text"))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part, part).alias("parts")).alias("content"))).alias("candidates")))
    listed = F.to_json(F.struct(F.array(F.struct(F.array(part).alias("content"))).alias("candidates")))
    payload = F.when(n == 0, parts).when(n == 1, listed).otherwise(F.lit('{"candidates":[]}'))
    return _t(spark, sf_dir, "events").select("event_id", json_text.candidate_text(payload).alias("candidate"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._ ()-]', '_', 'g'), '^\\.+', '') || '.csv' AS filename, lower(regexp_replace('GPT ' || p_name || '.Mini_é', '[^\\p{L}\\p{N}_-]', '', 'g')) AS slug FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23, X25."""
    upload = F.concat(F.lit("..\\up/ .x/../"), F.lit("."), "p_name", F.lit(".csv"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.safe_filename(upload).alias("filename"), text.model_slug(F.concat(F.lit("GPT "), "p_name", F.lit(".Mini_é"))).alias("slug"))


# --- requests and calls ----------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, '{"key":"' || s_suppkey || '","request":{"contents":[{"role":"user","parts":[{"text":"' || s_name || '"}]}],"generationConfig":{"maxOutputTokens":700}}}' AS line,
  's' || s_suppkey AS custom_id, 700 AS max_tokens, s_name AS content FROM supplier""")
def keyed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, K9: request lines by key, and requests in memory."""
    k = F.col("s_suppkey").cast("string")
    one = writers.request_struct(F.concat(F.lit("s"), k), F.col("s_name"), F.lit(700), F.lit("m"))
    out = _t(spark, sf_dir, "supplier").select("s_suppkey", writers.keyed_request(k, F.col("s_name"), F.lit(700)).alias("line"), one.alias("r"))
    return out.select("s_suppkey", "line", "r.custom_id", "r.params.max_tokens", F.col("r.params.messages")[0]["content"].alias("content"))


@query("SELECT p_partkey, 'Find it.' || chr(10) || 'Now.' || chr(10) || chr(10) || 'Locality: ' || p_name || chr(10) || 'Country: ' || p_brand || '!' AS prompt FROM part")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions from a file, read once."""
    path = f"{new_path(spark, 'instructions')}/prompt.md"
    writers.joined_files(spark, _empty(spark), path, b"Find it.\nNow.")
    return _t(spark, sf_dir, "part").select("p_partkey", coords.prompt(coords.instructions(spark, path), F.col("p_name"), F.col("p_brand"), F.lit("!")).alias("prompt"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.when(k % 7 == 0, (k % 80).cast("string"))
    return _t(spark, sf_dir, "customer").select(k.alias(S.ROW), k.cast("string").alias("Barcode"), F.col("c_name").alias("Locality verbatim"), F.col("c_mktsegment").alias("Country"), lat.alias("Latitude"), lat.alias("Longitude"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "Barcode", CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 80 WHEN c_custkey % 3 = 0 THEN 12.5 END AS "Latitude",
  CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'low' END AS "Confidence", CASE WHEN c_custkey % 3 = 0 THEN 'FR' ELSE c_mktsegment END AS "Country_Processed", c_name AS "Exact_Site",
  CASE WHEN c_custkey % 7 = 0 THEN 'coordinates_provided' WHEN c_custkey % 3 = 0 THEN 'estimated' ELSE 'failed' END AS "Coordinate_Source",
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'AI processing failed: refused | Error: refused' ELSE 'Response parsing failed: No valid JSON found in response | Error: No valid JSON found in response' END AS "Processing_Notes" FROM customer""")
def realtime_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, refused calls and answers that hold no object; given coordinates stay."""
    requests = calls.requests_of(prep.deduplicate(prep.filter_records(_places(spark, sf_dir), include_existing=True)), "")
    n = F.col("Barcode").cast("long") % 3
    answer = F.lit('{"country":"FR","latitude":12.5,"coordinate_source":"estimated","confidence":"high"}')
    ledger = requests.select("request_id", F.when(n == 0, answer).when(n == 2, F.lit("sorry")).alias("response"), F.when(n == 1, F.lit("refused")).alias("error"), F.lit(1).alias("attempts"))
    return calls.answered(requests, ledger).select("Barcode", "Latitude", "Confidence", "Country_Processed", "Exact_Site", "Coordinate_Source", "Processing_Notes")


class Refusing(calls.StubProvider):
    """Refuses prompts that end with 3; its rate is a limit that no test waits for."""

    name, requests_per_minute = "refusing", 6_000_000

    def call(self, prompt: str) -> str:
        if prompt.endswith("3"):
            raise calls.CallError(400, "refused")
        return super().call(prompt)


def _ledger(spark: SparkSession, sf_dir: str, keep: str) -> tuple[DataFrame, str]:
    requests = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("request_id"), F.col("c_name").alias("prompt"))
    path = f"{new_path(spark, 'ledger')}/calls"
    calls.settle(requests.where(keep), Refusing(), path, 2)
    return calls.settle(requests, Refusing(), path, 2), path


@query("SELECT CAST(c_custkey AS VARCHAR) AS request_id, 1 AS rows, 1 AS attempts, CASE WHEN c_name LIKE '%3' THEN 'refused' END AS error FROM customer")
def resumed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run calls only what the ledger lacks; errors that are not passing are not tried again."""
    ledger, _ = _ledger(spark, sf_dir, "request_id like '%1'")
    return ledger.groupBy("request_id").agg(F.count("*").cast("int").alias("rows"), F.sum("attempts").cast("int").alias("attempts"), F.first("error").alias("error"))


@query("SELECT count(*) AS api_calls, count(*) AS processed, count(*) FILTER (c_name LIKE '%3') AS failed, count(*) * 0.25 AS cost FROM customer")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    out = calls.run_statistics(_ledger(spark, sf_dir, "false")[0], 0.25)
    return out.withColumn("cost", F.col("cost").cast("double"))


@query("SELECT count(*) AS completed, count(*) AS api_calls, count(*) * 0.5 AS total_cost FROM customer")
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run stands; gone once cleared."""
    ledger, _ = _ledger(spark, sf_dir, "false")
    folder = _local(new_path(spark, "state"))
    source = os.path.join(folder, "in.csv")
    with open(source, "w", encoding="utf-8") as f:
        f.write("a\n")
    state.save_state(folder, source, ledger, 9, "m", 0.5)
    found = state.load_state(folder, source)
    cleared = state.clear_state(folder, source) and state.load_state(folder, source) is None
    return spark.createDataFrame([(found["completed"] if cleared else -1, found["api_calls"], float(found["total_cost"]))], "completed long, api_calls long, total_cost double")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS original, true AS answered, (SELECT ceil(count(*) / 40.0) FROM supplier) AS batches FROM supplier")
def staggered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-batches submitted one by one, waited for and fetched, with their source columns."""
    requests = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), "s_suppkey").alias("request_id"), F.col("s_name").alias("prompt"), F.col("s_suppkey").cast("string").alias("original"))
    folder = new_path(spark, "staggered")
    service = batches.FolderProvider(spark, f"{folder}/service", calls.StubProvider(), "google")
    summary = batches.submit_staggered(requests, ["request_id"], service, "m", folder, size=40, sleep=lambda _: None)
    ids = [b["batch_id"] for b in summary["batches"]]
    done = sum(batches.wait(service, i, sleep=lambda _: None)["status"] == "completed" for i in ids)
    out = batches.fetch(service, ids, requests.select(F.col("request_id").alias("Barcode"), "original"))
    return out.select("original", (F.col("Confidence") != "").alias("answered"), F.lit(float(done)).alias("batches"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS answered, (SELECT count(*) FROM customer) AS processed")
def streamed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of arriving files as a stream; its progress as it is told."""
    rows, folder, told = _places(spark, sf_dir), new_path(spark, "arrivals"), []
    rows.repartition(3).write.parquet(f"{folder}/in")
    listener = state.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        answered = calls.stream_process(spark, f"{folder}/in", rows.schema, f"{folder}/checkpoint", calls.StubProvider(), f"{folder}/ledger")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(answered, max((t["processed"] for t in told), default=0))], "answered long, processed long")


# --- jobs and models -------------------------------------------------------------------------------------------------


@query("SELECT 'single' AS kind, 'b' || n_nationkey AS batch_id, n_name AS dataset, CAST(n_nationkey * 3 AS BIGINT) AS record_count FROM nation UNION ALL SELECT 'staggered', NULL, r_name, CAST(100 + r_regionkey AS BIGINT) FROM region")
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved jobs, single and staggered; those that belong to a staggered one are not listed alone."""
    folder = _local(new_path(spark, "jobs"))
    for r in _t(spark, sf_dir, "nation").collect():  # 25 files
        state.save_job(folder, {"batch_id": f"b{r.n_nationkey}", "batch_name": f"n{r.n_nationkey}", "dataset": r.n_name, "record_count": r.n_nationkey * 3})
    for r in _t(spark, sf_dir, "region").collect():
        state.save_job(folder, {"dataset": r.r_name, "total_records": 100 + r.r_regionkey, "batches": [{"batch_id": "x", "record_count": 4}]}, staggered=True)
        state.save_job(folder, {"batch_id": f"part{r.r_regionkey}", "batch_name": f"p{r.r_regionkey}", "batch_number": 1})
    return jobs.list_jobs(spark, folder).select("kind", "batch_id", "dataset", "record_count")


@query("SELECT event_id, event_id % 7 IN (0, 5) AS ended, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END + 3 * event_id + 1 AS total FROM events")
def job_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, A13."""
    names = F.array(*[F.lit(x) for x in ("JOB_STATE_SUCCEEDED", "failed", "cancelled", "RUNNING", "", "Completed with errors", "pending")])
    n = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", jobs.ended(F.get(names, (n % 7).cast("int"))).alias("ended"), jobs.state_total(F.when(n % 2 == 0, n), n, n, n, F.lit(1)).alias("total"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 ELSE c_custkey % 5 = 0 END AS ready FROM customer")
def ready_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local models must be installed, others need a key of more than ten characters."""
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", cost.ready(k % 2 == 0, F.when(k % 3 == 0, True), F.when(k % 5 == 0, "elevenchars").otherwise("tencharact")).alias("ready"))


@query("""SELECT * FROM (VALUES ('claude_haiku_4_5', 'Anthropic', false, 0.001, 0.005, 50), ('claude_opus_4_8', 'Anthropic', false, 0.005, 0.025, 50), ('claude_sonnet_4_6', 'Anthropic', false, 0.003, 0.015, 50),
  ('gemini_3_1_pro', 'Google', false, 0.002, 0.012, 360), ('gemini_3_5_flash', 'Google', false, 0.0015, 0.009, 1000), ('gpt_4_1', 'OpenAI', false, 0.002, 0.008, 10000), ('gpt_4_1_mini', 'OpenAI', false, 0.0004, 0.0016, 10000),
  ('gpt_5', 'OpenAI', false, 0.00125, 0.01, 10000), ('gpt_5_mini', 'OpenAI', false, 0.00025, 0.002, 10000), ('openrouter_claude_haiku_4_5', 'OpenRouter', false, 0.001, 0.005, 200), ('openrouter_claude_opus_4_8', 'OpenRouter', false, 0.005, 0.025, 200),
  ('openrouter_claude_sonnet_4_6', 'OpenRouter', false, 0.003, 0.015, 200), ('openrouter_gemini_3_5_flash', 'OpenRouter', false, 0.0015, 0.009, 200), ('openrouter_gpt_4_1', 'OpenRouter', false, 0.002, 0.008, 200), ('openrouter_gpt_5_mini', 'OpenRouter', false, 0.00025, 0.002, 200),
  ('qwen3_14b_local', 'Local (Ollama)', true, 0.0, 0.0, 999999), ('qwen3_1_7b_local', 'Local (Ollama)', true, 0.0, 0.0, 999999), ('qwen3_8b_local', 'Local (Ollama)', true, 0.0, 0.0, 999999)) t(name, vendor, is_local, input_price, output_price, requests_per_minute)""")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17."""
    prices = [F.round(F.col(f"cost_per_1k_{k}"), 6).alias(f"{k}_price") for k in ("input", "output")]
    return cost.models(spark).select("name", "vendor", "is_local", *prices, F.col("requests_per_minute").cast("int").alias("requests_per_minute"))


@query("SELECT 10 AS previewed, 25 AS drawn, 25 AS different, 25 AS known")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows; rows drawn without replacement."""
    keys = _t(spark, sf_dir, "customer").select("c_custkey")
    drawn = profile.sample(keys, 25, 7)
    known = drawn.join(keys.withColumn("there", F.lit(1)), "c_custkey", "left").agg(F.count("*").cast("int").alias("drawn"), F.countDistinct("c_custkey").cast("int").alias("different"), F.sum("there").cast("int").alias("known"))
    return known.select(F.lit(profile.preview(keys, 10).count()).alias("previewed"), "drawn", "different", "known")


_SHARE = "printf('%.1f', round(count(*) FILTER (o_orderstatus = '{s}') * 100.0 / count(*), 1))"


@query(f"""SELECT unnest(['PROCESSING SUMMARY', 'Output: out.tsv', 'Model: m', 'Records: ' || regexp_replace(CAST(count(*) AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2'), 'Minutes: 1.5', 'Coordinate sources:', '  coordinates_provided: 0 (0.0%)', '  grid_reference_converted: 0 (0.0%)', '  coordinates_extracted: 0 (0.0%)',
  '  estimated: ' || regexp_replace(CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2') || ' (' || {_SHARE.format(s="F")} || '%)',
  '  no_coordinates: ' || regexp_replace(CAST(count(*) FILTER (o_orderstatus <> 'F') AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2') || ' (' || printf('%.1f', round(count(*) FILTER (o_orderstatus <> 'F') * 100.0 / count(*), 1)) || '%)', 'Confidence:',
  '  high: ' || regexp_replace(CAST(count(*) FILTER (o_orderstatus = 'P') AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2') || ' (' || {_SHARE.format(s="P")} || '%)', '  medium: 0 (0.0%)', '  low: 0 (0.0%)',
  '  unknown: ' || regexp_replace(CAST(count(*) FILTER (o_orderstatus <> 'P') AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2') || ' (' || printf('%.1f', round(count(*) FILTER (o_orderstatus <> 'P') * 100.0 / count(*), 1)) || '%)']) AS line FROM orders""")
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a summary, line by line."""
    status = F.col("o_orderstatus")
    rows = _t(spark, sf_dir, "orders").select(F.when(status == "F", "estimated").alias("Coordinate_Source"), F.when(status == "P", "high").alias("Confidence"))
    return spark.createDataFrame([(x,) for x in profile.report(rows, "out.tsv", "m", 90).split("\n")], "line string")
