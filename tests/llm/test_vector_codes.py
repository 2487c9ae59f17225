"""Vector codes against brute force: bounds, nearest entries, rounds, and the defined cases."""

import math
import random

import numpy as np
import pytest

from gazetta.llm import vector_codes as vc
from gazetta.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, Embedding string, id int, key string"


def _brute(rows, parts, entries, rounds):
    """rows: (id, vector, label) in the order of codebooks; plain Python numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (i, _, label), f in zip(kept, assign()):
        out.append((i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)))
    return books, out


@pytest.mark.parametrize("spread", [3, 40, 5000])
def test_bounds_and_nearest(spread):
    """Small spreads make ties and equal entries; the bounds must never lose the nearest entry, and must drop others."""
    rng = np.random.default_rng(spread)
    for k in (1, 2, 7, 64):
        for bits in (1, 3, 8):
            entries, parts = rng.integers(-spread, spread, (k, 4)), rng.integers(-2 * spread, 2 * spread, (300, 4))
            cells = vc.Cells(entries, bits)
            entry, away = cells.nearest(parts)
            all_away = ((parts[:, None] - entries) ** 2).sum(2)
            assert (away == all_away.min(1)).all() and (entry == all_away.argmin(1)).all()
    row, _ = vc.Cells(rng.integers(-5000, 5000, (64, 4))).candidates(rng.integers(-5000, 5000, (300, 4)))
    assert len(row) < 0.5 * 300 * 64


def _rows():
    rng = random.Random(9)
    rows = [(i * 3 - 40, [rng.choice([rng.gauss(0, 0.2), 0.0, -0.125, 1.5]) for _ in range(8)], rng.choice([None, 0, 0, 0, 1, i])) for i in range(120)]
    rows += [rows[5], rows[5], (rows[7][0], rows[9][1], 0), (None, rows[3][1], None), (None, None, 1)]
    bad = [(1, None, 0), (2, [], 0), (3, [math.nan] * 8, 0), (4, [math.inf] + [0.0] * 7, 1), (5, [None] + [0.0] * 7, 1), (6, [0.0] * 16, 1), (7, [0.0] * 5, None)]
    return rows[:-1] + bad


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "zz", "x", 1, "k") for i, v, label in rows], SCHEMA).repartition(5).toDF("vec_id", "embedding", "label", "code", "VEC", "id", "key")


def test_against_brute_force(spark):
    rows = _rows()
    good = [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1])]
    good = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in good]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    df = _frame(spark, rows).toDF("vec_id", "vec", "label", "code", "Vec", "id", "key")
    for entries, rounds in ((6, 2), (200, 1), (1, 0)):
        books, expected = _brute(good, 4, entries, rounds)
        found = vc.fit(df, vec_col="vec", parts=4, entries=entries, rounds=rounds)
        assert found.tolist() == books
        out = vc.label_errors(vc.encode(df, found, vec_col="vec")).collect()
        assert sorted(map(str, ((r.vec_id, r.label, r.code, r.error) for r in out))) == sorted(map(str, expected))
        for r in out:
            assert r.label_error == sum(e for _, label, _, e in expected if label == r.label)


def test_huge_components(spark):
    """Sums and distances stay within a long."""
    rows = [(i, [x * 1e38] * 16, 0) for i, x in enumerate((1.0, -1.0, 0.5))]
    df = _frame(spark, rows)
    out = vc.label_errors(vc.encode(df, vc.fit(df, entries=1))).collect()
    assert [r.error >= 0 for r in out] == [True] * 3 and len({r.label_error for r in out}) == 1


def test_nothing_to_code(spark):
    df = _frame(spark, [(1, None, 0)])
    for empty in (df, df.where("false")):
        books = vc.fit(empty)
        assert books.size == 0 and vc.label_errors(vc.encode(empty, books)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(32)], i % 3 or None) for i in range(90)] + [(99, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    books, expected = _brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows[:-1]], 16, 64, 2)
    out = QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == [(i, code, e) for i, _, code, e in expected]
    assert {r.codebooks_sha256 for r in out} == {vc.digest(np.array(books))}
