"""The georeferencing operators on literal tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gazetta import schema as S
from gazetta.functions import geo, json_text, text
from gazetta.operators import coords, cost, ensemble, jobs, prep, profile, resolve, results
from gazetta.plans import workflows
from gazetta.session import configure
from gazetta.sources import readers, writers
from gazetta.streaming import batches, calls, state


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    configure(spark)


def table(spark, columns, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, " + ", ".join(f"`{c}` string" for c in columns))
    return df


def one(df):
    return df.first().asDict()


# --- resolution ----------------------------------------------------------------------------------------------------


def test_aliases(spark):
    df = table(spark, ["Country", "country", "label_verbatim", "locality", "occurrenceID", "decimalLatitude", "Longitude"], ("  ", "France", " ", " Paris ", None, "48.8", "2.3"))
    got = one(resolve.resolve(df))
    assert (got["_ctry"], got["_loc"], got["_id"], got["_lat"], got["_lon"]) == ("France", "Paris", "Unknown", "48.8", "2.3")


def test_verbatim_hint(spark):
    df = table(spark, ["locality", "verbatimLatitude", "verbatimLongitude", "verbatimCoordinates", "Latitude", "Longitude"], ("Bog", "52 24N", "0 14W", "grid X", None, "1"), ("Bog", "52 24N", None, None, "1", "x"), (None, "1", "2", "", None, None))
    got = [r[0] for r in df.orderBy("_row").select(resolve.prompt_locality(df.columns)).collect()]
    assert got == ["Bog [verbatim coordinates: grid X; 52 24N 0 14W]", "Bog", "[verbatim coordinates: 1 2]"]


def test_column_predicates_and_order():
    assert resolve.has_locality_column(["X", "Sample location"]) and not resolve.has_locality_column(["place"])
    assert resolve.has_identifier_column(["gbifID"]) and resolve.has_identifier_column(["BARCODE x"]) and not resolve.has_identifier_column(["ident"])
    assert resolve.ordered_columns(["Confidence", "Barcode", "State", "Other", "Barcode"]) == ["Barcode", "Other", "State", "Confidence"]
    assert resolve.darwin_core_columns(["Barcode", "Country", "Country_Processed", "x"]) == ["catalogNumber", "country", "x"]


def test_darwin_core_collision(spark):
    df = table(spark, ["Country", "Country_Processed", "a.b"], ("France", "", "x"), ("France", "FR", None), (None, None, "y"))
    out = [tuple(r) for r in resolve.to_darwin_core(df.drop("_row")).collect()]
    assert sorted(out, key=str) == sorted([("France", "x"), ("FR", None), (None, "y")], key=str)


def test_safe_ids(spark):
    df = spark.createDataFrame([("GB-0408891",), ("RMNH.PISC.87661",), ("a" * 65,), ("x\n",)], "id string")
    got = [r[0] for r in df.select(text.safe_id(F.col("id"))).collect()]
    assert got[0] == "GB-0408891" and got[1] == "gz_0784a6fb113e36b439cd23cd" and all(g.startswith("gz_") and len(g) == 27 for g in got[1:])


def test_numbers(spark):
    values = ["1", " 2.5 ", "1_000", "1d", "NaN", "inf", ".5", "5.", "1e3", "", None, "٣", "-0"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.number(F.col("v"))).collect()]
    assert got == [1.0, 2.5, None, None, None, None, 0.5, 5.0, 1000.0, None, None, None, 0.0]


# --- preparation and expansion -------------------------------------------------------------------------------------

PLACES = [("1", " Alder Fen,  north\tbank ", "Ruritania"), ("2", "alder fen, north bank", "RURITANIA"), ("3", "Mill pond", "Ruritania"), ("1", "Alder Fen, North Bank", "ruritania"), ("5", "", "Ruritania")]


def test_prepare_and_expand(spark):
    df = table(spark, ["Barcode", "Locality verbatim", "Country"], *PLACES)
    stats = one(prep.filter_stats(df))
    assert stats == {"total": 5, "with_locality": 4, "with_valid_coordinates": 0, "selected": 4, "groups": 2, "duplicates_removed": 2}
    assert one(prep.filter_stats(df, max_records=3))["selected"] == 3
    groups = [r.asDict() for r in prep.tracking_as_text(prep.deduplicate(prep.filter_records(df))).orderBy("_row").collect()]
    assert [(g["Barcode"], g["dedup_key"], g["occurrence_ids"], g["occurrence_count"]) for g in groups] == [("1", "alder fen, north bank|ruritania", "1|2", "3"), ("3", "mill pond|ruritania", "3", "1")]
    done = prep.without_helpers(prep.deduplicate(prep.filter_records(df))).withColumns({"Latitude": F.lit("52.1"), "Longitude": F.lit("4.5"), "Confidence": F.lit("")})
    out = prep.expand(df.withColumn("Confidence", F.lit("old")), done)
    rows = out.orderBy("_row").collect()
    assert [r["Latitude"] for r in rows] == ["52.1"] * 4 + [None] and [r["Confidence"] for r in rows] == [""] * 4 + ["old"]
    assert one(prep.expand_stats(out)) == {"total": 5, "matched": 4, "unmatched": 1}


def test_existing_coordinates(spark):
    df = table(spark, ["Barcode", "locality", "Latitude", "Longitude"], ("1", "A", "0", "0"), ("2", "A", "999", "1"), ("3", "A", None, "1"))
    assert [r["Barcode"] for r in prep.filter_records(df).collect()] == ["2", "3"]
    assert prep.filter_records(df, include_existing=True).count() == 3
    done = table(spark, ["locality", "Latitude", "Longitude"], ("A", "5", "6"), ("a", "7", "8"))
    assert [r["Latitude"] for r in prep.expand(df, done).orderBy("_row").collect()] == ["7"] * 3
    assert [r["Latitude"] for r in prep.expand(df, done, protect_existing=True).orderBy("_row").collect()] == ["0", "7", "7"]


def test_last_result_is_last_by_ordinal(spark):
    """Results keep their ordinal, in whatever order they are scanned."""
    df = table(spark, ["Barcode", "locality"], ("1", "A"), ("2", "a"))
    done = table(spark, ["locality", "Latitude"], *[("A", str(i)) for i in range(40)])
    for rows in (done, done.orderBy(F.desc("_row")), done.repartition(7, "Latitude")):
        assert [r["Latitude"] for r in prep.expand(df, rows).orderBy("_row").collect()] == ["39", "39"]


def test_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [(str(i), f"place {rng.randint(0, 20)}", rng.choice(["A", "b"])) for i in range(300)]
    df = table(spark, ["Barcode", "locality", "Country"], *rows)
    want = [tuple(r) for r in prep.tracking_as_text(prep.deduplicate(prep.filter_records(df.coalesce(1)))).orderBy("_row").collect()]
    assert want == [tuple(r) for r in prep.tracking_as_text(prep.deduplicate(prep.filter_records(df.repartition(7)))).orderBy("_row").collect()]
    again = prep.deduplicate(prep.without_helpers(prep.deduplicate(df)).drop(*("dedup_key", "occurrence_ids", "occurrence_count")))
    assert again.count() == len(want)


# --- coordinates ---------------------------------------------------------------------------------------------------

GRID = {"SK4480": (444500, 380500, 53.320784, -1.331006, 707.1), "TL199798": (519950, 279850, 52.404618, -0.235723, 70.7), "SU306053": (430650, 105350, 50.847800, -1.563695, 70.7), "TL563705": (556350, 270550, 52.311879, 0.294646, 70.7), "grid ref: SK 44 80": (444500, 380500, 53.320784, -1.331006, 707.1)}


def test_grid_conversion(spark):
    bad = ["INVALID123", "SK123", "ZZ1234", "H123456", "of 1983", "in 1984", None, ""]
    df = spark.createDataFrame([(r,) for r in [*GRID, *bad]], "ref string")
    got = {r.ref: r for r in coords.convert_references(df, "ref").collect()}
    for ref, (e, n, lat, lon, radius) in GRID.items():
        r = got[ref]
        assert (r.easting, r.northing, round(r.lat, 6), round(r.lon, 6), round(r.radius, 1)) == (e, n, lat, lon, radius)
    assert all(got[b].lat is None and got[b].radius is None for b in bad)


def test_projection_reference_point(spark):
    df = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double")
    r = geo.with_grid_latlon(df, "e", "n").first()
    assert (round(r.lat - geo.SHIFT_LAT, 6), round(r.lon - geo.SHIFT_LON, 6)) == (52.657570, 1.717922)
    h = geo.with_grid_latlon(df, "e", "n", datum="helmert").first()
    assert abs(h.lat - 52.657977) < 2e-5 and abs(h.lon - 1.716038) < 4e-5


def test_grid_detection(spark):
    texts = ["SK/594086 and sk594086", "éSK594086", "SK12345", "of 1983 in 1984", "SK 594086", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(geo.grid_references(F.col("t"))).collect()]
    assert [len(g) for g in got] == [2, 0, 0, 2, 1, 0]


def test_priority_and_context(spark):
    df = table(spark, ["locality", "Latitude", "Longitude"], ("at TL199798", "0", "0"), ("of 1983, TL199798", "x", "0"), ("nowhere", None, None))
    rows = coords.preprocess(df).withColumn("context", coords.prompt_context()).orderBy("_row").collect()
    assert [r.pre_source for r in rows] == ["coordinates_provided", "grid_reference_converted", "needs_ai_processing"]
    assert rows[0].pre_lat == 0 and rows[1].pre_grid_ref == "TL199798" and rows[2].pre_lat is None
    assert "0.000000, 0.000000" in rows[0].context and "radius of 70.7 m" in rows[1].context and "no position" in rows[2].context


def test_haversine(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(50)] + [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    rows = df.select("*", geo.haversine(*map(F.col, "abcd")).alias("x"), geo.haversine(*map(F.col, "cdab")).alias("y")).collect()
    for r in rows:
        p, q = math.radians(r.a), math.radians(r.c)
        want = 6371 * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(r.d - r.b)))))
        assert abs(r.x - want) < 1e-2 and abs(r.x - r.y) < 1e-9
    assert rows[-2].x == 0


def test_categories(spark):
    km = [0.0, 1.99, 2.0, 4.99, 5.0, 9.99, 10.0, None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in km], "k double").select(geo.category(F.col("k"))).collect()]
    assert got == [S.CATEGORY_ORDER[i] for i in (0, 0, 1, 1, 2, 2, 3, 4)]


# --- comparison ----------------------------------------------------------------------------------------------------


def test_ensemble(spark):
    primary = table(spark, ["Barcode", "Latitude", "Longitude"], ("A", "10", "10"), ("B", "10", "10"), ("C", "10", "10"), ("D", "10", "10"), (" ", "1", "1"))
    secondary = table(spark, ["barcode", "latitude", "longitude", "Latitude"], ("A", "10.01", "10", ""), ("B", "10.03", "10", ""), ("C", "20", "10", ""), ("A", "50", "50", ""), ("X", "1", "1", ""), (None, "1", "1", ""))
    out = ensemble.compare(primary, secondary)
    assert [r[ensemble.CATEGORY] for r in out.orderBy("_row").collect()] == [S.CATEGORY_ORDER[i] for i in (0, 1, 3, 4, 4)]
    assert [tuple(r)[1:] for r in ensemble.summarise(out).collect()] == list(zip(S.CATEGORY_ORDER, (1, 1, 0, 1, 2)))
    assert ensemble.only_primary(primary, secondary).count() == 2 and [r.key for r in ensemble.only_secondary(primary, secondary).collect()] == ["X"]
    assert ensemble.duplicate_keys(secondary).first().duplicates == 1


# --- results -------------------------------------------------------------------------------------------------------


def test_json_extraction(spark):
    texts = ['{"a":1}', '```json\n{"a":1}\n```', 'Sure: {"a":1} done}', '{"a":"}{"}', "[1,2]", "nothing", None, '[{"a":1}]', 'use {braces} then {"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(json_text.first_object(F.col("t"))).collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"a": 1}] * 3 + [{"a": "}{"}] + [None] * 5
    again = [r[0] for r in df.select(json_text.rescan_objects(F.col("t"))).collect()]
    assert json.loads(again[-1]) == {"a": 1} and again[4] is None


def test_result_readers(spark):
    answer = '{"country":"X","latitude":"12.5","longitude":"bad","confidence":"high"}'
    chat = [json.dumps({"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": answer}}]}}}), json.dumps({"custom_id": "2", "response": {"status_code": 429}, "error": {"message": "slow"}}), ""]
    got = {r.barcode: r for r in results.chat_results(spark.createDataFrame([(c,) for c in chat], "value string")).collect()}
    assert got["1"].success and got["1"].latitude == 12.5 and got["1"].longitude is None and got["1"].state == ""
    assert not got["2"].success and got["2"].error == "slow" and len(got) == 2
    messages = [json.dumps({"custom_id": "1", "result": {"type": "succeeded", "message": {"content": [{"text": f"```json\n{answer}\n```"}]}}}), json.dumps({"custom_id": "2", "result": {"type": "expired"}})]
    got = {r.barcode: r for r in results.message_results(spark.createDataFrame([(c,) for c in messages], "value string")).collect()}
    assert got["1"].success and got["2"].error == "expired"
    keyed = [json.dumps({"key": "1", "response": {"candidates": [{"content": {"parts": [{"thought": True}, {"text": answer}]}}]}}), json.dumps({"key": "2", "a": {"b": [{"text": "no"}, {"text": answer}]}}), json.dumps({"key": "3", "response": {"candidates": [{"finishReason": "SAFETY"}]}})]
    got = {r.barcode: r for r in results.keyed_results(spark.createDataFrame([(c,) for c in keyed], "value string")).collect()}
    assert got["1"].success and got["2"].success and got["3"].error == "finishReason=SAFETY"
    whole = json.dumps({"inlinedResponses": [json.loads(k) for k in keyed]})
    got = {r.barcode: r.success for r in results.inlined_results(spark.createDataFrame([(whole,)], "value string")).collect()}
    assert got == {"0": True, "1": True, "2": False}


def test_merge_with_source(spark):
    source = table(spark, ["Barcode", "note"], ("http://x/1", "first"), ("B2", "two"), ("http://x/1", "last"))
    none = ", ".join(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in S.RESPONSE if f.name not in ("country", "confidence"))
    raw = spark.sql(f"select * from values ('http://x/1', true, null, 'FR', null), ('B2', false, 'quota', null, null), ('gone', true, null, 'DE', 'low') as t(id, success, error, country, confidence)")
    found = raw.select(text.safe_id(F.col("id")).alias("barcode"), "success", F.col("error").cast("string").alias("error"), "country", F.col("confidence").cast("string").alias("confidence"), *[F.expr(x) for x in none.split(", ")])
    got = {r["Barcode"]: r for r in results.merge_with_source(found, source).collect()}
    assert (got["http://x/1"]["note"], got["http://x/1"]["Country_Processed"], got["http://x/1"]["Confidence"]) == ("last", "FR", "medium")
    assert got["B2"]["Processing_Notes"] == "Batch processing failed: quota" and got["B2"]["Confidence"] == "low" and got["gone"]["note"] is None


def test_failed_rows(spark):
    df = table(spark, ["Processing_Notes", "Coordinate_Source"], ("Batch Processing Failed: x", None), ("a | Error: b", "estimated"), ("fine", "Failed"), (None, None))
    assert one(results.processing_counts(df)) == {"total": 4, "failed": 3, "successful": 1}


# --- cost, profile, jobs -------------------------------------------------------------------------------------------


def test_costs(spark):
    df = spark.createDataFrame([(100, 0.25, 1.25), (0, 0.25, 1.25)], "n long, i double, o double")
    get = lambda **k: [round(r.estimated_cost, 9) for r in cost.estimate(df, F.col("n"), F.col("i"), F.col("o"), **k).collect()]
    assert get(cached=False) == [0.0175, 0] and get() == [0.013, 0] and get(batch=True, cached=False) == [0.00875, 0]
    ranked = cost.compare_models(cost.models(spark), 1000)
    assert ranked.first().estimated_cost == 0 and ranked.count() == len(cost.MODELS)
    assert cost.cheapest_and_fastest(ranked).first().fastest.startswith("qwen")
    r = cost.batch_cost(spark.createDataFrame([(25,)], "n long"), F.col("n"), F.lit(10), F.lit(0.001), F.lit(0.002), F.lit(60)).first()
    assert r.num_batches == 3 and abs(r.total_cost - (3 * 2600 / 1000 * 0.001 + 3 * 1300 / 1000 * 0.002)) < 1e-12 and r.estimated_time_minutes == 3


def test_profile(spark):
    df = table(spark, ["Barcode", "locality", "Latitude", "Longitude", "Coordinate_Source"], ("1", "abcd", "1", "2", "estimated"), ("2", None, None, None, "odd"))
    got = one(profile.statistics(df))
    assert got["total_records"] == 2 and got["has_coordinates"] and got["has_locality"] and got["avg_locality_length"] == 4 and got["field_count"] == 5
    assert [(r.value, r.n) for r in profile.source_counts(df).orderBy("position").collect()] == [("coordinates_provided", 0), ("grid_reference_converted", 0), ("coordinates_extracted", 0), ("estimated", 1), ("no_coordinates", 1)]
    assert profile.sample(df, 1, 3).count() == 1 and "estimated: 1 (50.0%)" in profile.report(df.withColumn("Confidence", F.lit("high")), "o", "m", 60)
    assert one(profile.statistics(df.limit(0)))["total_records"] == 0


def test_jobs(spark, tmp_path):
    df = spark.range(1050).withColumn("x", F.hash("id"))
    rows = jobs.sub_batches(df, ["x", "id"], 500).orderBy("x", "id").collect()
    assert [(r.batch_number, r.start_record, r.end_record) for r in (rows[0], rows[499], rows[500], rows[1049])] == [(1, 1, 500), (1, 1, 500), (2, 501, 1000), (3, 1001, 1050)]
    info = {"batch_id": "b1", "submitted_at": "2024-01-02", "dataset": "d", "record_count": 3, "output_formats": ["csv"]}
    (tmp_path / "a_info.json").write_text(json.dumps(info, indent=1))
    (tmp_path / "b_info.json").write_text(json.dumps(info | {"batch_number": 1}))
    (tmp_path / "c_info.json").write_text("{broken")
    (tmp_path / "s_staggered_summary.json").write_text(json.dumps({"dataset": "s", "submitted_at": "2024-02-01", "total_records": 9, "batches": [{"batch_id": "x", "record_count": 4}, {"batch_id": "y", "record_count": 5}]}))
    assert [(r.kind, r.record_count) for r in jobs.list_jobs(spark, str(tmp_path)).collect()] == [("staggered", 9), ("single", 3)]
    assert jobs.summary_batches(jobs.read_summaries(spark, str(tmp_path))).agg(F.sum("record_count")).first()[0] == 9
    assert jobs.provider_stagger("Google AI") == (500, 120)


# --- files ---------------------------------------------------------------------------------------------------------

CSV = '﻿catalogNumber,Country,country,"verbatimLocality",x.y\n1,,France,"a, ""b""\nsecond line",1\n2,Spain,,short\n'


def test_read_delimited(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV, encoding="utf-8")
    df = readers.read_delimited(spark, str(path))
    rows = df.orderBy("_row").collect()
    assert df.columns[:5] == ["catalogNumber", "Country", "country", "verbatimLocality", "x.y"]
    assert rows[0]["verbatimLocality"] == 'a, "b"\nsecond line' and rows[1]["x.y"] is None and len(rows) == 2
    assert [r["_ctry"] for r in resolve.resolve(df).orderBy("_row").collect()] == ["France", "Spain"]
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "z.TSV").write_text("id\tlocality\n1\tx\n")
    found = readers.discover_datasets(spark, str(tmp_path)).collect()
    assert [(f.filename, f.delimiter, f.row_count) for f in found] == [("t.csv", ",", 2), ("z.TSV", "\t", 1)]


def test_json_sources(spark, tmp_path):
    for name, data in {"list": [{"id": 1}, {"id": 2}], "results": {"results": [{"id": 1}]}, "geo": {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "a", "Latitude": None}, "geometry": {"type": "Point", "coordinates": [3.5, 50.25]}}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert readers.load_records(spark, f"{tmp_path}/list.json").count() == 2
    assert readers.load_records(spark, f"{tmp_path}/results.json").first()["id"] == "1"
    r = readers.load_records(spark, f"{tmp_path}/geo.json").first()
    assert (float(r["Latitude"]), float(r["Longitude"])) == (50.25, 3.5)


def test_exports(spark, tmp_path):
    df = table(spark, ["Latitude", "Barcode", "Longitude", "note"], ("0", "é", "0", "a\tb"), ("x", "2", "1", None))
    paths, unknown = writers.export_all(df, f"{tmp_path}/out.v1", ["csv", "tsv", "json", "geojson", "xls"])
    assert unknown == ["xls"] and all(p.startswith(f"{tmp_path}/out.v1.") for p in paths)
    raw = open(paths[0], "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines()[0] == "Barcode,note,Latitude,Longitude"
    assert [r["Barcode"] for r in json.load(open(paths[2], encoding="utf-8"))] == ["é", "2"]
    features = json.load(open(paths[3], encoding="utf-8"))["features"]
    assert len(features) == 1 and features[0]["geometry"]["coordinates"] == [0.0, 0.0] and set(features[0]["properties"]) == {"Barcode", "note"}
    assert "catalogNumber" in open(writers.export_delimited(df, f"{tmp_path}/d.csv", darwin_core=True), encoding="utf-8-sig").readline()


def test_workflow_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text("Barcode\tLocality verbatim\tCountry\n" + "".join(f"{a}\t{b.replace(chr(9), ' ')}\t{c}\n" for a, b, c in PLACES), encoding="utf-8")
    stats = workflows.prepare(spark, str(path))
    assert (stats["total"], stats["selected"], stats["groups"]) == (5, 4, 2)
    lines = open(stats["output"], encoding="utf-8-sig").read().splitlines()
    assert len(lines) == 3 and lines[0].endswith("dedup_key\toccurrence_ids\toccurrence_count")
    done = tmp_path / "done.tsv"
    done.write_text("\n".join([lines[0] + "\tLatitude\tLongitude"] + [x + "\t1\t2" for x in lines[1:]]) + "\n", encoding="utf-8")
    out = workflows.expand(spark, str(path), str(done), darwin_core=True)
    assert (out["total"], out["matched"]) == (5, 4)
    text_out = open(out["output"], encoding="utf-8-sig").read()
    assert "occurrence_count" not in text_out and "decimalLatitude" in text_out.splitlines()[0]
    summary, written = workflows.compare(spark, out["output"], out["output"], f"{tmp_path}/cmp", ["csv"])
    assert sum(r.n for r in summary.collect()) == 5 and len(written) == 1


# --- calls ---------------------------------------------------------------------------------------------------------


def test_process_is_resumable(spark, tmp_path):
    df = table(spark, ["Barcode", "locality", "Country"], ("1", "A", "x"), ("2", "a ", "X"), ("3", "at TL199798", "x"), ("4", None, "x"))
    ledger = f"{tmp_path}/ledger"
    out = calls.process(df, calls.StubProvider(), ledger, concurrency=2).orderBy("_row").collect()
    assert [r["__matched"] for r in out] == [True, True, True, False] and out[0]["Latitude"] == out[1]["Latitude"]
    assert out[2]["Coordinate_Source"] == "grid_reference_converted" and round(float(out[2]["Latitude"]), 3) == 52.405
    assert "dedup_key" not in out[0].asDict()
    before = calls.read_ledger(spark, ledger).count()
    calls.process(df, calls.StubProvider(), ledger, concurrency=2).count()
    assert calls.read_ledger(spark, ledger).count() == before == 2
    assert calls.run_statistics(calls.read_ledger(spark, ledger), 0.5).first().cost == 1.0


class Flaky:
    name, requests_per_minute = "flaky", 0

    def __init__(self, fails, status):
        self.left, self.status = fails, status

    def call(self, prompt):
        self.left -= 1
        if self.left >= 0:
            raise calls.CallError(self.status, "busy")
        return "{}"


def test_retries():
    waits = []
    assert calls.call_with_retry(Flaky(3, 429), "p", waits.append) == ("{}", None, 4) and waits == [3, 6, 12]
    assert calls.call_with_retry(Flaky(1, 400), "p", waits.append) == (None, "busy", 1)
    assert calls.call_with_retry(Flaky(9, 529), "p", waits.append)[2] == 6


@pytest.mark.parametrize("provider", ["openai", "google"])
def test_staggered_batches(spark, tmp_path, provider):
    df = table(spark, ["Barcode", "locality", "Country"], *[(str(i), f"place {i}", "x") for i in range(7)])
    requests = calls.requests_of(prep.deduplicate(prep.filter_records(df)), "Do")
    service = batches.FolderProvider(spark, str(tmp_path / "svc"), calls.StubProvider(), provider)
    waits = []
    summary = batches.submit_staggered(requests, ["request_id"], service, "m", str(tmp_path), size=3, sleep=waits.append)
    assert [b["record_count"] for b in summary["batches"]] == [3, 3, 1] and len(waits) == 2
    ids = [b["batch_id"] for b in summary["batches"]]
    assert batches.wait(service, ids[0])["succeeded"] == 3
    out = batches.fetch(service, ids, requests.select("request_id", F.col("Barcode").alias("original"), S.ROW).withColumnRenamed("request_id", "Barcode"))
    assert sorted(r["original"] for r in out.collect()) == [str(i) for i in range(7)]


def test_folder_batches_are_answered_together(spark, tmp_path):
    """The number of Spark jobs does not follow the number of sub-batches."""
    requests = spark.createDataFrame([(f"r{i}", f"place {i}") for i in range(60)], "request_id string, prompt string")

    def jobs_of(size):
        group = f"staggered {size}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            service = batches.FolderProvider(spark, f"{tmp_path}/svc{size}", calls.StubProvider(), "openai")
            summary = batches.submit_staggered(requests, ["request_id"], service, "m", f"{tmp_path}/{size}", size=size, sleep=lambda _: None)
            ids = [b["batch_id"] for b in summary["batches"]]
            assert sum(batches.wait(service, i, sleep=lambda _: None)["succeeded"] for i in ids) == 60
            assert len({r.barcode for r in service.results_of(ids).collect()}) == 60
            assert sorted(r.barcode for r in service.results(ids[-1]).collect()) == sorted(f"r{i}" for i in range(60))[-size:]
            return len(ids), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (few, a), (many, b) = jobs_of(30), jobs_of(3)
    assert (few, many) == (2, 20) and b <= a + 5
    with pytest.raises(FileNotFoundError):
        batches.FolderProvider(spark, str(tmp_path / "svc"), calls.StubProvider()).submit(str(tmp_path / "none"))


def test_stream(spark, tmp_path):
    df = table(spark, ["Barcode", "locality", "Country"], *[(str(i), f"place {i % 3}", "x") for i in range(6)])
    df.where("_row < 2").write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/cp", calls.StubProvider(), f"{tmp_path}/ledger")
    assert calls.stream_process(*args) == 2
    df.where("_row >= 2").write.mode("append").parquet(f"{tmp_path}/in")
    assert calls.stream_process(*args) == 3


def test_stream_counts_rows_once(spark, tmp_path, monkeypatch):
    """Also where nothing stays cached, as on executors that fill a cache beside each other."""
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: self)
    told, df = [], table(spark, ["Barcode", "locality", "Country"], *[(str(i), f"place {i % 3}", "x") for i in range(6)])
    df.write.parquet(f"{tmp_path}/in")
    spark.streams.addListener(listener := state.Progress(told.append))
    try:
        assert calls.stream_process(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/cp", calls.StubProvider(), f"{tmp_path}/ledger") == 3
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert max(t["processed"] for t in told) == 6


def test_output_names():
    from datetime import datetime

    assert writers.dated_output("o", "/d/set.csv", "GPT 5.mini", datetime(2024, 1, 2, 3, 4, 5)) == "o/20240102_set_gpt5mini/set_gpt5mini_20240102_030405.tsv"
    assert writers.with_extension("a.b", "csv") == "a.b.csv" and writers.default_candidates("/x/a.b.tsv") == "/x/a.b_candidates.tsv"


def test_result_payloads_take_the_plain_way(spark):
    """A standard keyed line is read without Python."""
    answer = json.dumps({"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": '{"latitude": 2}'}]}}]}})
    df = spark.createDataFrame([(answer,)], "value string")
    payload = F.get_json_object("value", "$.response")
    assert df.select(json_text.candidate_text(payload)).first()[0] == '{"latitude": 2}'
    assert results.keyed_results(df).first().latitude == 2


def test_texts_in_any_payload():
    deep = {"text": "end"}
    for _ in range(20):
        deep = {"x": [deep]}
    assert json_text.texts_in({"a": [{"text": "one"}, {"text": {"text": "two"}}], "text": "three", "b": 5, "c": deep}) == ["one", "two", "three"]
    assert json_text.texts_in("text") == [] and json_text.texts_in(None) == []


def test_delimited_files_are_split_and_ordered(spark, tmp_path):
    """Small splits, several files: rows keep the order of paths and places; quoted line breaks are found."""
    for name, first in (("b.tsv", 5000), ("a.tsv", 0)):
        (tmp_path / name).write_text("Barcode\tnote\n" + "".join(f"{first + i}\t{'x' * (i % 40)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_delimited(spark, f"{tmp_path}/*.tsv", "\t")
        assert df.rdd.getNumPartitions() > 4
        assert [int(r.Barcode) for r in df.orderBy("_row").collect()] == list(range(10000)) and df.select("_row").distinct().count() == 10000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert readers.has_quoted_line_breaks(spark, f"{tmp_path}/c.csv") and not readers.has_quoted_line_breaks(spark, f"{tmp_path}/a.tsv")
    assert [tuple(r)[:2] for r in readers.read_delimited(spark, f"{tmp_path}/c.csv").orderBy("_row").collect()] == [("1", "x\ny"), ("2", "z")]


def test_exported_fields_are_quoted_where_needed(spark, tmp_path):
    import csv

    rows = [(0, "a,b", 1.5, True, ["x", "y"]), (1, 'q"q', None, False, None), (2, "line\nbreak", -0.25, None, []), (3, "", 12.0, True, ["é"])]
    df = spark.createDataFrame(rows, "_row long, s string, d double, b boolean, l array<string>").repartition(3)
    with open(writers.export_delimited(df, f"{tmp_path}/q.csv"), encoding="utf-8-sig", newline="") as f:
        got = list(csv.reader(f))
    assert got == [["s", "d", "b", "l"], ["a,b", "1.5", "True", '["x","y"]'], ['q"q', "", "False", ""], ["line\nbreak", "-0.25", "", "[]"], ["", "12.0", "True", '["é"]']]
    assert json.load(open(writers.export_json(df.limit(0), f"{tmp_path}/none.json"))) == []
    assert [r["s"] for r in json.load(open(writers.export_json(df, f"{tmp_path}/all.json")))] == [r[1] for r in rows]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["all.json", "none.json", "q.csv"]


class Failing:
    name, requests_per_minute = "failing", 0

    def call(self, prompt):
        if "lost" in prompt:
            raise calls.CallError(400, "refused")
        return "no object here"


def test_failed_records_say_so(spark, tmp_path):
    df = table(spark, ["Barcode", "locality", "Country"], ("1", "lost", "x"), ("2", "odd", "x"))
    out = {r["Barcode"]: r for r in calls.process(df, Failing(), f"{tmp_path}/ledger", concurrency=1).collect()}
    assert out["1"]["Processing_Notes"] == "AI processing failed: refused | Error: refused" and out["1"]["Coordinate_Source"] == "failed"
    assert out["2"]["Processing_Notes"] == "Response parsing failed: No valid JSON found in response | Error: No valid JSON found in response"
    assert (out["2"]["Exact_Site"], out["2"]["Country_Processed"], out["2"]["Confidence"], out["2"]["Latitude"]) == ("odd", "x", "low", None)
    assert results.processing_counts(calls.process(df, Failing(), f"{tmp_path}/ledger", concurrency=1)).first().failed == 2


class Slow(calls.StubProvider):
    requests_per_minute = 600


def test_rate_limit(spark):
    import time

    requests = spark.createDataFrame([(str(i), "p") for i in range(8)], "request_id string, prompt string")
    calls.call_stage(requests.limit(1), calls.StubProvider(), 1).collect()
    start = time.monotonic()
    assert calls.call_stage(requests, Slow(), 1).count() == 8
    assert time.monotonic() - start >= 7 * 0.1


def test_newest_outputs_first(spark, tmp_path):
    import os

    for name, at in (("b.csv", 2_000_000_000), ("a.csv", 1_000_000_000), ("c.tsv", 1_500_000_000)):
        (tmp_path / name).write_text("x\n")
        os.utime(tmp_path / name, (at, at))
    assert [r.name for r in readers.discover_outputs(spark, str(tmp_path)).collect()] == ["b.csv", "c.tsv", "a.csv"]
