"""Helpers shared by the training-data operators: shared-folder tables and exact byte confirmation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitmaps import key_bitmap, may_hold  # noqa: F401
from ..session import materialise, new_path, shared_dir  # noqa: F401


def rank_key(id_col: Column, *then: Column) -> Column:
    """A struct that orders rows by id, null ids last."""
    return F.struct(id_col.isNull().alias("none"), id_col.alias("id"), *then)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Rows that are sent to a Python worker at once, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS.  Executor and worker each hold whole batches of each
    task, in buffers that double as they fill, so 10,000 texts at once take many times what the operators need."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def arrow_fields(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: str, judge: Callable[[list], list], most_chars: int = 2_000_000) -> DataFrame:
    """The columns ``keep`` and what ``judge`` returns: for a list of texts, a list of Arrow arrays in the order of ``fields``.

    Kept columns pass through as Arrow arrays, so ids and further columns of any type come back as they were.  Texts
    are judged about ``most_chars`` characters at a time, which bounds the memory whatever the batch holds.  A text that
    is kept is sent once.
    """
    kept = [f"__k{i}" for i in range(len(keep))]
    read = kept[keep.index(text_col)] if text_col in keep else "__text"
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], *[F.col(f"`{text_col}`").alias(read)] * (read not in kept))
    names = [x.split()[0] for x in _split_fields(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, chars = [], 0, 0
            for i, value in enumerate(batch.column(read)):
                texts.append(text := value.as_py())
                chars += len((text.get("text") if isinstance(text, dict) else text) or "")
                if chars > most_chars or i + 1 == len(batch):
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + judge(texts), names=kept + names)
                    texts, at, chars = [], i + 1, 0

    out = source.mapInArrow(run, ", ".join(x for x in (arrow_fields(source, kept), fields) if x))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *names)


def by_place(df: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df with neutral column names, the new name of each, and what gives the old names back, but for those that results have.

    Names of helpers then cannot clash with those of the data, nor names that differ in case alone with each other."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new, strict=True)), [F.col(n).alias(c) for c, n in zip(df.columns, new, strict=True) if c not in results]


def _split_fields(fields: str) -> list[str]:
    """Top-level parts of a DDL list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(fields[at:i])
            at = i + 1
    return [*out, fields[at:]]


#: Bits of the filter that `possible` broadcasts, whatever the number of keys: 131,072 rows of 64 bits.
FILTER_BITS = 1 << 23


def possible(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, flag: str = "__possible") -> DataFrame:
    """Adds ``flag``: false only if ``key`` is surely not among ``keys``.

    One hash per key in a bitmap of fixed size, so what is broadcast has a bound; a full bitmap only makes more rows
    possible.  It spares rows that have no partner the way through a shuffle."""
    words = keys.select(F.pmod(F.xxhash64(keys_key), F.lit(FILTER_BITS)).alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("__bits"))
    place = df.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).withColumn("__word", F.shiftright("__at", 6))
    met = place.join(F.broadcast(words), "__word", "left")
    return met.withColumn(flag, F.expr("coalesce(shiftrightunsigned(__bits, cast(__at % 64 as int)) & 1L, 0L) = 1L")).drop("__word", "__bits", "__at")


def shuffled(df: DataFrame) -> DataFrame:
    """Keeps a join with df a sort-merge join at every size: its needs grow in proportion, and hot keys can be split."""
    return df.hint("merge")


#: Keys that hold at least one of so many rows of a table are joined by broadcast: there are at most so many.
HOT_PARTS = 1000


def hot_keys(left: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """The keys that hold at least one of ``parts`` rows of left (read from a table), at most ``parts``."""
    least = max(left.count() / parts, 2)
    return materialise(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key), "hot")


def joined_by_hot_key(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join of left (read from a table) with right (one row a key).

    Rows of left with one of the few hot keys stay where they are and meet a broadcast of as many rows of right, so no task
    gathers a key that a third of all rows have; the others are dealt out by key."""
    hot = hot_keys(left, key) if hot is None else hot
    few = F.broadcast(materialise(right.join(F.broadcast(hot), key), "hot-rows"))
    cold = left.join(F.broadcast(hot), key, "left_anti").join(shuffled(right), key)
    return left.join(few, key).unionByName(cold)


#: Plans whose rows are rows of files, the same ones at every reading.
_FILE_PLANS = ("LogicalRelation", "Project", "Filter", "SubqueryAlias")


def _has_file_rows(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    if "_metadata" in df.columns or not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in _FILE_PLANS:
        if not plan.children().size():
            try:
                df.select("_metadata.row_index")
            except AnalysisException:  # a format without row numbers
                return False
            return True
        plan = plan.children().apply(0)
    return False


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number (long) that is the same whenever a branch reads the result: the place of the row's file among
    the paths in order, then the row's place in the file.

    Rows that do not come straight from Parquet files, such as those of joins or groups, have no place that a second
    reading would find again; they are written once and read back."""
    if not _has_file_rows(df):
        df = materialise(df, "rows")
    files = df.select(F.col("_metadata.file_path").alias("__file")).distinct().agg(F.sort_array(F.collect_set("__file")).alias("f"))
    files = materialise(files.select(F.posexplode("f").alias("__ordinal", "__file")), "files")
    files = F.broadcast(files) if files.count() <= MOST_FILES else shuffled(files)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    number = F.shiftleft(F.col("__ordinal").cast("long"), 40) + F.col("__row")
    return placed.join(files, "__file").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


#: File names sent to every executor at most.
MOST_FILES = 200_000
