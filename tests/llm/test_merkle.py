"""The manifest against brute force: ranks, proofs, tampering, and the defined cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gazetta.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, Text string, payload int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _siblings(levels, place):
    found = []
    for nodes in levels[:-1]:
        first = place // 3 * 3
        found.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 3])))
        place //= 3
    return found


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] if r[0] is not None else 0, _leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = _siblings(trees[s], place) + _siblings(top, k)
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                at = _leaf((*r[:4], r[4] and r[4].replace("\n", "")))
            for left, right in path:
                at = _h(left, at, right)
            out.append((r[0], s, place, leaf, trees[s][-1][0], top[-1][0], _h(*[x + y for x, y in path]), at, at == top[-1][0]))
    return sorted(map(str, out))


def _found(df):
    where = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.manifest(df, fields=FIELDS, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=where)
    cols = ("id", "group", "place", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof"), "folded_root", "verified")
    return sorted(str(tuple(r)) for r in out.select(*cols).collect())


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "g", "Text", 1) for r in rows], SCHEMA).toDF(*FIELDS, "g", "TEXT2", "payload").repartition(4)


def _docs(n, seed=1, ids=None, sources=(None, "", "a", "a", "a", "é", "z=")):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "one\ntwo", "one two", "naïve\n\n漢字", "x" * rng.randint(0, 9)])
    return [((ids or (lambda i, r: i))(i, rng), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, i]), text()) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 82, 700])
def test_sizes(spark, n):
    rows = _docs(n, n)
    assert _found(_frame(spark, rows)) == _brute(rows)


def test_ids_of_any_kind_of_spread(spark):
    """Null, negative, sparse, repeated and equal ids; equal rows."""
    ids = lambda i, r: r.choice([None, i, -i, r.randrange(-(2**63), 2**63), 7, 2**40 + i % 5])
    rows = _docs(300, 5, ids)
    rows += rows[:40] + rows[:10]
    assert _found(_frame(spark, rows)) == _brute(rows)


def test_crowded_ids_and_copies(spark, monkeypatch):
    """One id shared by many different rows goes on with the digits of leaves; copies are written out in blocks."""
    monkeypatch.setattr(merkle, "BUCKET", 8)
    monkeypatch.setattr(merkle, "_COPIES", 7)
    rows = _docs(200, 6, lambda i, r: r.choice([3, 3, 3, None, i]))
    rows = [(*r[:4], f"{i}\n") for i, r in enumerate(rows)] + [(3, "a", "en", 1, "same\n")] * 60
    assert _found(_frame(spark, rows)) == _brute(rows)


def test_many_groups(spark):
    """A tree over the groups of several runs of levels."""
    rows = _docs(400, 7, sources=[f"s{i}" for i in range(250)])
    assert _found(_frame(spark, rows)) == _brute(rows)


def test_text_ids_and_empty(spark):
    rows = [(f"id{i % 40}" if i % 9 else None, "s", None, i, "t\n") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars long, text string")
    out = merkle.manifest(df).collect()
    order = sorted(out, key=lambda r: r.place)
    assert [r.id for r in order] == sorted((r[0] for r in rows), key=lambda x: (x is not None, (x or "").encode()))
    assert all(r.verified for r in out) and {r.root for r in out} == {_levels([r.leaf for r in order])[-1][0]}
    assert merkle.manifest(df.where("false")).collect() == []


def test_root_ignores_files(spark):
    """However rows are dealt, the manifest is the same."""
    rows = _docs(150, 8, lambda i, r: i % 60)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    one, other = (merkle.manifest(x).select("root", "leaf", "place", "folded_root").collect() for x in (df.coalesce(1), df.orderBy(F.rand(3)).repartition(7)))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_long_text(spark):
    rows = [(1, "a", "en", 1, "long\n" * 400_000), (2, "a", "en", 2, "short")]
    assert _found(_frame(spark, rows)) == _brute(rows)
