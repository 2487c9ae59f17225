"""Vector codes: each of a vector's parts becomes the number of its nearest entry in that part's codebook.

Method (vector approximation file): the coordinates of a codebook's entries are quantised into cells of a few bits.  A
query's tables give, for each coordinate and cell, the smallest and the largest squared distance there; their sums bound
the distance to every entry.  Only entries whose lower bound does not exceed the smallest upper bound are compared by
integer distances.  Components become floor(256 * x), so all sums and distances are whole numbers.

A codebook is refined by rounds over all rows: tasks add up the parts that fall to each entry, the sums of tasks are
added by Spark, and what reaches the driver is one row an entry (parts x entries), whatever the number of vectors.
Errors by label are added in the same way and joined back by hot key, so a label that a third of all rows share gathers
in no task.

Defined cases: rows whose vector is null, empty or holds null or non-finite components go; so do rows whose length is not
that of most vectors (of tied lengths the larger), or does not divide into the parts.  Components whose squared distances
could exceed a long count as the largest that cannot.  Rows that share an id are told apart by their components; rows
without id follow all others.  Repeated rows come back each; fewer rows than entries make shorter codebooks; an empty
table gives no rows; null labels are one label.  Further columns of any name are ignored unless they are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, joined_by_hot_key, materialise, rank_key

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits of a cell: a coordinate of a codebook has at most 2 ** CELL_BITS cells.
CELL_BITS = 3
SCALE = 256
#: Vectors looked up at a time.
_TOGETHER = 2048


class Cells:
    """A codebook of one part (entries x width, whole numbers) behind its approximations."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        cells = min(1 << bits, len(entries))
        marks = np.sort(entries, axis=0)[np.linspace(0, len(entries) - 1, cells + 1).astype(int)]  # as many entries in each cell, about
        self.low, self.high = marks[:-1].T, marks[1:].T  # width x cells, both ends belong to the cell
        self.cell = [np.searchsorted(marks[1:-1, d], entries[:, d], "right") for d in range(entries.shape[1])]

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all pairs whose bounds overlap, in order."""
        least, most = np.zeros((len(parts), len(self.entries)), np.int64), np.zeros((len(parts), len(self.entries)), np.int64)
        for d, cell in enumerate(self.cell):
            below, above = self.low[d] - parts[:, d, None], parts[:, d, None] - self.high[d]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[:, cell]
            most += (far * far)[:, cell]
        return np.nonzero(least <= most.min(axis=1, keepdims=True))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (of tied ones the first) and its squared distance."""
        row, entry = self.candidates(parts)
        away = parts[row] - self.entries[entry]
        away = (away * away).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(away, first)
        return np.minimum.reduceat(np.where(away == best[row], entry, len(self.entries)), first), best


def _whole(values: np.ndarray, dim: int, parts: int) -> np.ndarray:
    """Rows x parts x width of floor(SCALE * x), kept where squared distances over all components fit a long."""
    most = math.isqrt((1 << 60) // dim)
    return np.clip(np.floor(SCALE * values), -most, most).astype(np.int64).reshape(-1, parts, dim // parts)


def _kept(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int) -> tuple[DataFrame, int]:
    """id, label and vector (array<double>) of the rows that stay, and the length they have; 0: there are none."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}  # by place, so that names may differ in case alone
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = rows.select(F.col(names[id_col]).alias("id"), (F.col(names[label_col]) if label_col else F.lit(None).cast("int")).alias("label"), F.col(names[vec_col]).cast("array<double>").alias("vec"))
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = rows.where(F.coalesce(fits & (F.size("vec") > 0), F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).where(F.col("dim") % parts == 0)
    found = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    dim = found["dim"] if found else 0
    return rows.where(F.size("vec") == dim), dim


def _vectors(batch: pa.RecordBatch, dim: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of a batch: where each begins and its whole numbers."""
    for at in range(0, batch.num_rows, _TOGETHER):
        some = batch.column("vec").slice(at, _TOGETHER)
        yield at, _whole(some.flatten().to_numpy().reshape(-1, dim), dim, parts)


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width): those of the smallest ids, refined over all rows in each round."""
    rows, dim = _kept(df, id_col, vec_col, None, parts)
    if not dim:
        return np.zeros((parts, 0, 0), np.int64)
    first = rows.orderBy(rank_key(F.col("id"), F.col("vec").alias("vec"))).limit(entries).select("vec").collect()
    books = np.ascontiguousarray(_whole(np.array([r["vec"] for r in first]), dim, parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _refined(rows.select("vec"), books, dim)
    return books


def _refined(rows: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    parts, entries, width = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and sums of what a task has read, a row for each entry in use."""
        cells = [Cells(b) for b in books]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, some in _vectors(batch, dim, parts):
                for p in range(parts):
                    entry, _ = cells[p].nearest(some[:, p])
                    n[p] += np.bincount(entry, minlength=entries)
                    np.add.at(sums[p], entry, some[:, p])
        part, entry = np.nonzero(n)
        arrays = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "n", *[f"s{d}" for d in range(width)]])

    fields = ["part int", "entry int", "n long", *[f"s{d} long" for d in range(width)]]
    total = [F.sum("n").alias("n"), *[F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]]
    out = books.copy()
    for r in rows.mapInArrow(added, ", ".join(fields)).groupBy("part", "entry").agg(*total).collect():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    return out


def encode(df: DataFrame, books: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for each row that stays: id, label, code (two hex digits a part) and error (long)."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    rows, dim = _kept(df, id_col, vec_col, label_col, parts)
    if dim != parts * width:  # nothing was fitted, or for another length
        rows = rows.where(F.lit(False))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            for at, some in _vectors(batch, dim, parts):
                found = [cells[p].nearest(some[:, p]) for p in range(parts)]
                digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                here = [batch.column(c).slice(at, len(some)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*here, pa.array(codes), pa.array(sum(away for _, away in found))], names=["id", "label", "code", "error"])

    out = rows.mapInArrow(coded, arrow_fields(rows, ["id", "label"]) + ", code string, error long")
    return out.toDF(id_col, label_col, "code", "error")


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds label_error (long; null where the sum exceeds it): the error of all rows with an equal label, nulls together."""
    id_col = coded.columns[0]
    keyed = coded.toDF("id", "label", "code", "error").withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    rows = materialise(keyed, "codes")
    sums = rows.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return joined_by_hot_key(rows, materialise(sums, "label-errors"), "key").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
