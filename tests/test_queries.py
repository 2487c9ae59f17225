"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry_points
from gazetta.plans import file_queries, text_queries  # noqa: F401  register their queries
from gazetta.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, (bool, str)) else float(v) if isinstance(v, (int, float, Decimal)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = QUERIES[name](spark, DATA)
    result = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(out.columns)
    want = sorted((tuple(map(_plain, r)) for r in result.fetchall()), key=str)
    got = sorted((tuple(map(_plain, r)) for r in out.select(*columns).collect()), key=str)
    assert got == want


def _tables(spark, folder, **rows):
    for name, (columns, *values) in rows.items():
        spark.createDataFrame(values, columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_results_of_pages_with_one_url(spark, tmp_path):
    """Every result finds its own page."""
    data = _tables(spark, tmp_path, pages=("page_id long, url string", (1, "http://a.b/c"), (2, "http://a.b/c"), (4, "http://a.b/c"), (5, "x")))
    got = sorted((r.page_id, r.Barcode, r.Latitude, r.Confidence) for r in QUERIES["results_join"](spark, data).collect())
    assert got == [(1, "http://a.b/c", "1.0", "medium"), (2, "http://a.b/c", "2.0", "medium"), (4, "http://a.b/c", None, "low"), (5, "x", "5.0", "medium")]


def test_comparison_rounds_and_knows_no_distance_without_match(spark, tmp_path):
    """A latitude just below a tie goes down as in the SQL; a row without a match has no distance, which is a category of its own."""
    price = 262714.0
    data = _tables(spark, tmp_path, customer=("c_custkey long", (14,), (15,)), orders=("o_custkey long, o_orderkey long, o_totalprice double", (14, 1, price), (14, 2, 1.0)))
    got = {r.k: r for r in QUERIES["ensemble_compare"](spark, data).collect()}
    assert got[14].matched and got[14].secondary_lat == -65.934321
    assert (got[15].matched, got[15].secondary_lat, got[15].km, got[15].category) == (False, None, None, "no comparison")


def test_entry_contract(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    if os.path.isdir(DATA):
        assert entry_points.entry(spark).columns == ["key", "first_row", "barcode", "ids", "n"]
