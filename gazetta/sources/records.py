"""Lines and records of text files in file order, read by many tasks however large a file is.

Order.  Spark packs a full split of a file into a task of its own; only a file's last split may share one.  So twice the
split's first byte plus the place in the task grows along a file, and no scan is needed to learn about splits.

Quoted line breaks.  Whether a line begins inside a quoted field depends on all lines before it.  A line either leaves that
state, turns it over or sets it, so states run along a split by sums and last values, and along the splits of a file by the
same rule over one row a split.  Lines that are records of their own are not moved again; only the lines of longer records
are gathered, by record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import ref
from ..session import materialise

BOM = "﻿"
#: Bits of the ordinal that hold the place in a file (8 TB); files are numbered above them.
PLACE_BITS = 44
#: Rows about files or splits sent to every executor at most.
MOST_ROWS = 200_000


def in_file_order(df: DataFrame, keep_split: bool = False) -> DataFrame:
    """Adds the input ordinal to a plain scan: by path, then place in the file.  keep_split: also __file and __from, the path and the split's first byte."""
    own = [ref(c) for c in df.columns]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(*own, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), within.alias("__in"))
    files = sorted({re.sub(r"^([^:/]+):///", r"\1:/", f) for f in df.inputFiles()})  # as _metadata writes them
    place = F.col("__from") * 2 + F.col("__in")
    if len(files) > 1:
        ranks = df.sparkSession.createDataFrame([(f, i << PLACE_BITS) for i, f in enumerate(files)], "__file string, __rank long")
        rows = rows.join(F.broadcast(ranks) if len(files) <= MOST_ROWS else ranks.hint("merge"), "__file")
        place += F.col("__rank")
    return rows.select(*own, *[F.col(c) for c in ("__file", "__from") if keep_split], place.alias(S.ROW))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, __file, __from and the ordinal of every line; lines end with \\n, a \\r before it stays."""
    found = in_file_order(spark.read.option("lineSep", "\n").text(path), keep_split=True)
    return found.withColumn("value", F.when(F.col("__from") == 0, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")))


def _open_after(value: Column, sep: str) -> Column:
    """Whether a quoted field is open at the end of a text that begins outside of one; quotes inside plain fields are text."""
    rest = F.regexp_replace(value, rf'(^|{sep})"[^"]*+(?:""[^"]*+)*+"', "x")
    return rest.rlike(rf'(^|{sep})"')


def _ends(value: Column, sep: str) -> Column:
    """struct(outside, inside): whether a field is open after a line that begins outside of one, or inside."""
    sep = re.escape(sep).replace("\t", "t")
    closing = r'^[^"]*+(?:""[^"]*+)*+"(?!")'
    inside = F.when(value.rlike(closing), _open_after(F.regexp_replace(value, closing, "x"), sep)).otherwise(F.lit(True))
    plain = ~value.contains('"')
    return F.struct(F.when(plain, False).otherwise(_open_after(value, sep)).alias("outside"), F.when(plain, True).otherwise(inside).alias("inside"))


def _running(df: DataFrame, along: Window, sets: Column, turns: Column) -> DataFrame:
    """Adds __known (the state before a row, as far as the rows before set it, else null), __turned (turns since then, or
    since the start) and the same after it.  sets: the state a row sets (0, 1) or null; turns: whether it turns it over."""
    so_far = F.sum(turns.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("__turned", so_far).withColumn("__fixed", (sets + F.col("__turned")) % 2)
    df = df.withColumn("__known", F.last("__fixed", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    return df.withColumn("__before", F.col("__turned") - turns.cast("int"))


def _splits(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_ROWS else df.hint("merge")


def records(found: DataFrame, separators: dict[str, str] | str) -> DataFrame:
    """Records of `lines`: __file, value (its lines joined by \\n, without a last \\r), the ordinal of its first line, and
    header, whether it is its file's first.  separators: one for all files, or one for each path.

    A field that is never closed makes one record of the rest of its file, as for any reader of such files."""
    if isinstance(separators, str):
        ends = _ends(F.col("value"), separators)
    else:
        ends, by_sep = F.lit(None), {s: [f for f, x in separators.items() if x == s] for s in sorted(set(separators.values()))}
        for s, paths in by_sep.items():
            ends = F.when(F.col("__file").isin(paths), _ends(F.col("value"), s)).otherwise(ends)
    rows = found.withColumn("__e", ends).select("value", "__file", "__from", S.ROW, F.col("__e.outside").alias("__out"), F.col("__e.inside").alias("__ins"))
    along = Window.partitionBy("__file", "__from").orderBy(S.ROW)
    sets = F.when(F.col("__out") == F.col("__ins"), F.col("__out").cast("int"))
    rows = materialise(_running(rows, along, sets, F.col("__out") & ~F.col("__ins")), "lines")

    fixed = F.max_by("__fixed", F.when(F.col("__fixed").isNotNull(), F.col(S.ROW)))
    splits = rows.groupBy("__file", "__from").agg(fixed.alias("__fixed"), F.max("__turned").alias("__all"), F.min(S.ROW).alias("__first"))
    in_file = Window.partitionBy("__file").orderBy("__from")
    splits = splits.select("__file", "__from", "__first", ((F.col("__fixed") + F.col("__all")) % 2).alias("__sets"), ((F.col("__all") % 2 == 1) & F.col("__fixed").isNull()).alias("__turns"))
    splits = _running(splits, in_file, F.col("__sets"), F.col("__turns"))
    begins = (F.coalesce("__known", F.lit(0)) + F.col("__before")) % 2
    splits = materialise(splits.select("__file", "__from", begins.alias("__begins"), F.min("__first").over(Window.partitionBy("__file")).alias("__head")), "splits")

    met = rows.join(_splits(splits), ["__file", "__from"])
    met = met.withColumn("__inside", (F.coalesce("__known", "__begins") + F.col("__before")) % 2 == 1)
    met = met.withColumn("__open", F.when(F.col("__inside"), F.col("__ins")).otherwise(F.col("__out")))
    end = F.regexp_replace("value", "\r$", "").alias("value")
    header = (F.col(S.ROW) == F.col("__head")).alias("header")
    alone = met.where("not __inside and not __open").select("__file", end, S.ROW, header)
    parts = met.where("__inside or __open").select("__file", "__from", "value", S.ROW, "__head", F.when(~F.col("__inside"), F.col(S.ROW)).alias("__start"))
    carried = parts.groupBy("__file", "__from").agg(F.max("__start").alias("__carried"))
    carried = carried.select("__file", "__from", F.last("__carried", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    local = F.last("__start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.withColumn("__local", local).join(_splits(materialise(carried, "carried")), ["__file", "__from"])
    parts = parts.withColumn("__record", F.coalesce("__local", "__carried"))
    whole = parts.groupBy("__file", "__record").agg(F.sort_array(F.collect_list(F.struct(F.col(S.ROW).alias("row"), "value"))).alias("all"), F.max("__head").alias("__head"))
    whole = whole.select("__file", F.array_join("all.value", "\n").alias("value"), F.col("__record").alias(S.ROW), "__head")
    return alone.unionByName(whole.select("__file", end, S.ROW, header))


def parsed(found: DataFrame, names: list[str], sep: str) -> DataFrame:
    """The fields of records as text columns, and the ordinal; headers and blank records are left out."""
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    rows = found.where(~F.col("header") & (F.trim("value") != "")).select(F.from_csv("value", fields, options).alias("r"), S.ROW)
    return rows.select("r.*", S.ROW).toDF(*names, S.ROW)
