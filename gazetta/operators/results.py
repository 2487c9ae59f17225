"""Model results: from provider files and responses to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.json_text import candidate_text, deep_texts, error_message, first_object, object_map, rescan_objects, response_fields, strip_fences
from ..functions.text import ref, safe_id
from .resolve import with_row


def _outcome(df: DataFrame, key: Column, text: Column, error: Column, rescan: bool) -> DataFrame:
    """barcode, success, error, raw_response and the response fields; a line is never lost."""
    rows = df.select(key.alias("barcode"), text.alias("raw_response"), error.alias("error"))
    rows = rows.withColumn("__plain", strip_fences(F.when(F.col("error").isNull(), F.col("raw_response"))))
    rows = rows.withColumn("__found", first_object(F.col("__plain"), stripped=True))  # parsed once
    if rescan:  # only texts that hold a brace and gave nothing go to Python
        rows = rows.withColumn("__found", F.coalesce("__found", rescan_objects(F.when(F.col("__found").isNull() & F.col("error").isNull() & F.contains("raw_response", F.lit("{")), F.col("raw_response")))))
    rows = rows.withColumn("__fields", object_map(F.col("__found"))).withColumn("__o", response_fields(F.col("__fields")))
    ok = F.col("__o").isNotNull()
    why = F.when(~ok, F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("No valid JSON found in response")))
    return rows.select("barcode", ok.alias("success"), why.alias("error"), "raw_response", *[F.col(f"__o.{f.name}").alias(f.name) for f in S.RESPONSE])


def chat_results(lines: DataFrame, rescan: bool = False) -> DataFrame:
    """Lines {custom_id, response: {status_code, body: {choices}}}."""
    v = F.col("value")
    status = F.get_json_object(v, "$.response.status_code")
    error = F.when(~F.coalesce(status == "200", F.lit(False)), F.coalesce(F.when(error_message(v) != "", error_message(v)), F.concat(F.lit("status "), F.coalesce(status, F.lit("missing")))))
    return _outcome(lines.where(F.trim("value") != ""), F.get_json_object(v, "$.custom_id"), F.get_json_object(v, "$.response.body.choices[0].message.content"), error, rescan)


def message_results(lines: DataFrame, rescan: bool = False) -> DataFrame:
    """Lines {custom_id, result: {type, message: {content: [{text}]}}}."""
    v = F.col("value")
    kind = F.get_json_object(v, "$.result.type")
    error = F.when(~F.coalesce(kind == "succeeded", F.lit(False)), F.coalesce(F.get_json_object(v, "$.result.error.message"), F.get_json_object(v, "$.result.error.error.message"), kind, F.lit("unknown")))
    return _outcome(lines.where(F.trim("value") != ""), F.get_json_object(v, "$.custom_id"), F.get_json_object(v, "$.result.message.content[0].text"), error, rescan)


def keyed_results(lines: DataFrame) -> DataFrame:
    """Lines {key, response} of any depth: the first "text" string that holds an object wins."""
    v = F.col("value")
    rows = lines.where(F.trim("value") != "").withColumn("__text", candidate_text(F.coalesce(F.get_json_object(v, "$.response"), v)))
    rows = rows.withColumn("__deep", deep_texts(F.when(F.col("__text") == "", v)))  # only payloads of another shape go to Python
    text = F.coalesce(F.when(F.col("__text") != "", F.col("__text")), F.get(F.filter("__deep", lambda t: t.contains("{")), F.lit(0)))
    rows = rows.withColumn("__text", text)
    error = F.when(F.col("__text").isNull(), F.coalesce(F.when(error_message(v) != "", error_message(v)), F.lit("empty response")))
    return _outcome(rows, F.get_json_object(v, "$.key"), F.col("__text"), error, True)


def inlined_results(payloads: DataFrame) -> DataFrame:
    """Documents {inlinedResponses: [...]} without keys: the place in the list is the key."""
    # outer: else the optimizer parses the list once more in a filter
    items = payloads.select(F.posexplode_outer(F.from_json(F.get_json_object("value", "$.inlinedResponses"), "array<string>")).alias("at", "item")).where(F.col("at").isNotNull())
    return keyed_results(items.select(F.to_json(F.struct(F.col("at").cast("string").alias("key"), F.col("item").alias("item"))).alias("__k"), "at", "item").select(F.concat(F.lit('{"key":"'), F.col("at"), F.lit('","response":'), F.col("item"), F.lit("}")).alias("value")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A result file, a folder or an object-store prefix of *.jsonl."""
    return spark.read.text(path)


def merge_with_source(results: DataFrame, source: DataFrame, id_col: str = "Barcode") -> DataFrame:
    """Every result with the columns of its source row.

    Submitted ids are safe ids, so one equi-join on the safe id serves both raw and hashed ids; of source rows with
    the same id the last wins."""
    others = [c for c in source.columns if c != S.ROW]
    last = with_row(source).groupBy(safe_id(ref(id_col)).alias("__key")).agg(F.max_by(F.struct(*[ref(c) for c in others]), F.col(S.ROW)).alias("__s"))
    joined = results.join(last, safe_id(F.col("barcode")) == F.col("__key"), "left")
    ok = F.col("success")
    produced = {}
    for name, field in S.RESPONSE_OF.items():
        value = F.col(field).cast("string")
        if name == "Confidence":
            value = F.when(ok, F.coalesce(value, F.lit("medium"))).otherwise(F.lit("low"))
        elif name == "Processing_Notes":
            value = F.when(ok, F.coalesce(value, F.lit(""))).otherwise(F.concat(F.lit("Batch processing failed: "), F.coalesce("error", F.lit("unknown"))))
        else:
            value = F.when(ok, value)
        produced[name] = value
    own = [F.coalesce(F.col("__s")[c].cast("string"), F.col("barcode")).alias(c) if c == id_col else F.col("__s")[c].alias(c) for c in others if c not in produced]
    return joined.select(*own, *[v.alias(k) for k, v in produced.items()])


def realtime_columns(loc: Column, ctry: Column, response: str = "__o") -> dict[str, Column]:
    """Produced columns of a parsed response (a struct column, with success, error, called); given coordinates are kept.

    A failed call (not ``called``) and an answer that does not parse keep country and locality and say so in their notes."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    out = {}
    for name, field in S.RESPONSE_OF.items():
        value = F.col(response)[field]
        if name == "Country_Processed":
            value = F.coalesce(F.when(value != "", value), ctry)
        elif name == "Exact_Site":
            value = F.coalesce(F.when(value != "", value), loc)
        elif name == "Latitude":
            value = F.coalesce("pre_lat", value)
        elif name == "Longitude":
            value = F.coalesce("pre_lon", value)
        elif name == "Confidence":
            value = F.when(ok, F.coalesce(value, F.lit("medium"))).otherwise(F.lit("low"))
        elif name == "Processing_Notes":
            value = F.when(ok, F.coalesce(value, F.lit(""))).otherwise(failure_note(F.col("called"), F.coalesce("error", F.lit("unknown"))))
        elif name == "Coordinate_Source":
            value = F.when(F.col("pre_source") != "needs_ai_processing", F.col("pre_source")).when(ok, value).otherwise(F.lit("failed"))
        elif name == "Coordinate_Radius_Meters":
            value = F.coalesce("pre_radius", value)
        out[name] = value
    return out


def failure_note(called: Column, error: Column) -> Column:
    what = F.when(called, F.lit("Response parsing failed: ")).otherwise(F.lit("AI processing failed: "))
    return F.concat(what, error, F.lit(" | Error: "), error)


def failed(notes: Column, source: Column) -> Column:
    """Whether a record says that its processing failed."""
    text = F.lower(F.coalesce(notes, F.lit("")))
    marks = ("processing failed", "response parsing failed", "| error:")
    said = F.lit(False)
    for mark in marks:
        said = said | text.contains(mark)
    return said | F.coalesce(F.lower(source) == "failed", F.lit(False))


def processing_counts(df: DataFrame, notes: str = "Processing_Notes", source: str = "Coordinate_Source") -> DataFrame:
    bad = failed(F.col(notes), F.col(source))
    return df.agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("successful"))


def success_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def fetched_rate(fetched: DataFrame, expected: int) -> DataFrame:
    return fetched.agg(F.count("*").alias("fetched"), (F.count("*") / F.lit(float(expected)) if expected else F.lit(0.0)).alias("rate"))


def request_parameters(model_id: Column) -> Column:
    """struct(max_tokens, effort): reasoning models get room and minimal effort, "pro" ones think a little."""
    name = F.lower(model_id)
    reasoning = name.contains("gpt-5") | name.rlike(r"^o[0-9]")
    return F.struct(F.when(reasoning, F.lit(4000)).otherwise(F.lit(1000)).alias("max_tokens"), F.when(reasoning, F.lit("minimal")).when(name.contains("pro"), F.lit("low")).alias("effort"))
