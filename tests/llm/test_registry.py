"""The registered queries: all thirteen and the pipeline are there, run on the smallest tables and equal their SQL."""

import os

import pytest

import __spark_entry__ as entry_points
from gazetta.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id host path rule verdict",
    2: "doc_id keep_id group_size kept text_sha256",
    3: "doc_id held_out lang_pred score",
    4: "doc_id n_words n_hit n_items items_sha256 contaminated",
    5: "doc_id class_id class_size stays",
    6: "doc_id text n_sentences n_removed",
    7: "page_id url text n_chars",
    8: "doc_id n_assign n_access n_hex base_sha256 spans",
    9: "doc_id piece start length ids_crc32 sequence_id offset",
    10: "doc_id text lines_removed chunks_removed",
    11: "vec_id code error label_error codebooks_sha256",
    12: "doc_id n_tokens ids_sha256 decoded_sha256",
    13: "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_all_are_registered():
    found = entry_points.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    import duckdb

    out = QUERIES[name](spark, DATA)
    number = int(name[2:].split("_")[0])
    assert out.columns == COLUMNS[number].split()
    rows = sorted((tuple(r) for r in out.collect()), key=str)
    table = {1: "pages", 7: "pages", 11: "embeddings"}.get(number, "documents")
    whole = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert len(rows) >= whole if number == 9 else len(rows) == whole
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        assert rows == sorted(db.execute(ORACLE_SQL[name]).fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_languages(spark):
    """Documents that fitting never saw."""
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(out) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
