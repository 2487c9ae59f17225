"""Delimited files read by many tasks: order, quoted line breaks over split boundaries, discovery in a fixed number of jobs."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gazetta.sources import readers, records


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few lines, so that states and records cross many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _table(rng, n, columns, sep, end):
    """Fields with quotes, separators, line breaks, and quotes inside plain fields."""
    plain = ["", "a", "5\" pipe", "x\"\"y", "ä漢", " b ", "''"]
    special = ["line\nbreak", "\n", "a\"b", f"a{sep}b", "\"", "\"\"", f"{sep}\"\n\"{sep}", "x\n\ny", "\"\n"]
    rows, text = [], io.StringIO()
    for _ in range(n):
        row, cells = [], []
        for _ in range(columns):
            v = rng.choice(plain if rng.random() < 0.6 else special)
            row.append(v)
            cells.append(v if v in plain else '"' + v.replace('"', '""') + '"')
        rows.append(row)
        text.write(sep.join(cells) + end)
    return rows, text.getvalue()


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_quoted_line_breaks(spark, tmp_path, tiny_splits, sep):
    rng = random.Random(sep)
    path = tmp_path / "a file.csv"
    rows, text = _table(rng, 300, 4, sep, "\r\n" if sep == ";" else "\n")
    path.write_text(records.BOM + sep.join("wxyz") + "\n" + text, encoding="utf-8", newline="")
    df = readers.read_delimited(spark, str(path), sep)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 30
    found = [[v or "" for v in tuple(r)[:4]] for r in df.orderBy("_row").collect()]
    expected = [[v.strip() if v == "''" else v for v in r] for r in rows]
    plain = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=False))
    assert len(plain) == len(rows)
    assert found == expected


def test_order_over_files(spark, tmp_path, tiny_splits):
    """Small, large and empty files, packed into tasks in any order; names with blanks."""
    expected = []
    for name, n in (("a b", 3), ("c", 500), ("d", 0), ("e", 1), ("f%41", 120)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{name},{i}\n" for i in range(n)))
        expected += [(name, str(i)) for i in range(n)]
    df = readers.read_delimited(spark, f"{tmp_path}/*.csv", ",")
    assert [tuple(r)[:2] for r in df.orderBy("_row").collect()] == expected
    assert df.select("_row").distinct().count() == len(expected)


def test_unclosed_and_blank(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,x\n\n   \n2,"open\nto the\nend\n')
    out = readers.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("_row").collect()
    assert [r.k for r in out] == ["1", "2"] and out[1].v.replace('"', "").split("\n")[:2] == ["open", "to the"]
    (tmp_path / "b.csv").write_text("k,v\n")
    assert readers.read_delimited(spark, str(tmp_path / "b.csv"), line_breaks=True).collect() == []


def test_discovery(spark, tmp_path, tiny_splits, monkeypatch):
    """Counts agree with the reader, whatever the files hold; the number of jobs does not follow that of files."""
    rng, all_files = random.Random(5), readers.files
    for i in range(12):
        sep = rng.choice(",\t;|")
        _, text = _table(rng, rng.randint(0, 20), 3, sep, "\n") if i % 2 else (None, f"1{sep}2\n" * i)
        (tmp_path / f"t {i}.csv").write_text(sep.join(["locality", "id", "x"]) + "\n" + text, newline="")
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "other.json").write_text("{}")
    jobs = {}
    for few in ("t [01].csv", "t *.csv"):
        spark.sparkContext.setJobGroup(few, "")
        monkeypatch.setattr(readers, "files", lambda spark, folder, few=few: all_files(spark, f"{folder}/{few}"))
        found = readers.discover_datasets(spark, str(tmp_path)).collect()
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(few))
    spark.sparkContext.setJobGroup("other", "")
    monkeypatch.setattr(readers, "files", all_files)
    found = readers.discover_datasets(spark, str(tmp_path)).orderBy("filename").collect()
    assert len(found) == 12 and max(jobs.values()) - min(jobs.values()) <= 2
    for r in found:
        df = readers.read_delimited(spark, r.filepath.replace("%20", " "))
        assert (r.row_count, r.delimiter, r.columns) == (df.count(), readers.detect_delimiter(spark, r.filepath.replace("%20", " ")), ["locality", "id", "x"]), r


def test_plan_reads_in_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("k,v\n" + '1,"a\nb"\n' * 400)
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.count() == 400 and df.agg(F.countDistinct("_row")).first()[0] == 400
