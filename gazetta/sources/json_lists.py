"""Records of JSON lists of any size: a root array, or an array under one of a root object's keys.

Such a file has no line that a task could begin at, so it is cut at every `}` by the splittable text reader.  Where a piece
stands follows from all pieces before it: whether inside a string (from the number of quotes) and how deep (from brackets
outside of strings).  Both are running sums along a split, made for a split that begins outside a string and for one that
begins inside, and sums over one row a split choose between them.  A record ends where the depth falls to that of the list;
its pieces are gathered by record, and records of one piece are not moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialise, new_path
from .records import MOST_ROWS, in_file_order

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Elements of a list that are no records (plain values and lists of plain values), and what stands between elements.
_SCALARS = rf"^(?:[\s,]|null|true|false|-?\d[\d.eE+-]*|{_STRING}|\[(?:[^\[\]{{}}\"]|{_STRING})*+\])*+"


def _bare(text: Column) -> Column:
    """The text without strings; one that is not closed goes to the end."""
    return F.regexp_replace(F.regexp_replace(text, '"[^"]*+"', ""), '"[^"]*+$', "")


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed in text without strings."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, __file, __from, the ordinal, __p (quotes before, modulo 2, within the split), __d0 and __d1 (depth after the
    piece within the split, if that begins outside or inside a string), __flip, __o and __i (of the piece alone)."""
    rows = in_file_order(spark.read.option("lineSep", "}").text(path), keep_split=True)
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    rows = rows.withColumn("__plain", plain).withColumn("__flip", (quotes % 2).cast("int"))
    # the bracket that ends a piece counts if no string is open there
    outside = _depth(_bare(F.col("__plain"))) - F.when(F.col("__flip") == 0, 1).otherwise(0)
    inside = F.when(F.col("__plain").contains('"'), _depth(_bare(F.regexp_replace("__plain", '^[^"]*+"', "")))).otherwise(0) - F.when(F.col("__flip") == 1, 1).otherwise(0)
    rows = rows.withColumn("__o", outside).withColumn("__i", inside).drop("__plain")
    along = Window.partitionBy("__file", "__from").orderBy(S.ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__p", (F.sum("__flip").over(along) - F.col("__flip")) % 2)
    first, second = F.when(F.col("__p") == 0, F.col("__o")).otherwise(F.col("__i")), F.when(F.col("__p") == 0, F.col("__i")).otherwise(F.col("__o"))
    return materialise(rows.withColumn("__d0", F.sum(first).over(along)).withColumn("__d1", F.sum(second).over(along)), "pieces")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_ROWS else df.hint("merge")


def _placed(pieces: DataFrame) -> DataFrame:
    """value, __file, __from, the ordinal, before (depth), after, __in (whether the piece begins in a string) and __shut (whether it ends outside)."""
    ends = pieces.groupBy("__file", "__from").agg((F.sum("__flip") % 2).alias("flip"), F.max_by("__d0", S.ROW).alias("d0"), F.max_by("__d1", S.ROW).alias("d1"))
    earlier = Window.partitionBy("__file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__s", F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2)
    ends = ends.withColumn("__base", F.coalesce(F.sum(F.when(F.col("__s") == 0, F.col("d0")).otherwise(F.col("d1"))).over(earlier), F.lit(0)))
    met = pieces.join(_small(materialise(ends.select("__file", "__from", "__s", "__base"), "splits")), ["__file", "__from"])
    within = (F.col("__p") + F.col("__s")) % 2 == 1
    after = F.col("__base") + F.when(F.col("__s") == 0, F.col("__d0")).otherwise(F.col("__d1"))
    own = F.when(within, F.col("__i")).otherwise(F.col("__o"))
    return met.select("value", "__file", "__from", S.ROW, (after - own).alias("before"), after.alias("after"), within.alias("__in"), (within == (F.col("__flip") == 1)).alias("__shut"))


def _list_begins(placed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """__file, begins (ordinal of the piece with the list's bracket), head (characters up to it) and target (the list's depth)."""
    text = F.col("value")
    root = placed.groupBy("__file").agg(F.min(S.ROW).alias("begins"), F.min_by("value", S.ROW).alias("value"))
    root = root.where(F.ltrim("value").startswith("[")).select("__file", "begins", F.length(F.regexp_extract("value", r"^\s*\[", 0)).alias("head"), F.lit(1).alias("target"), F.lit(0).alias("order"))
    found = root
    for order, key in enumerate(keys, 1):
        head = F.regexp_extract(text, rf'^(?s)(.*?)"{key}"\s*:\s*\[(?!\s*\])', 1)
        whole = F.regexp_extract(text, rf'^(?s).*?"{key}"\s*:\s*\[(?!\s*\])', 0)
        plain = F.regexp_replace(head, r"\\.", "")
        at = placed.where(text.rlike(rf'"{key}"\s*:\s*\[(?!\s*\])') & ~F.col("__in"))
        at = at.where((F.col("before") + _depth(_bare(plain)) == 1) & ((F.length(plain) - F.length(F.replace(plain, F.lit('"')))) % 2 == 0))
        found = found.unionByName(at.groupBy("__file").agg(F.min(S.ROW).alias("begins"), F.min_by(F.length(whole), S.ROW).alias("head")).select("__file", "begins", "head", F.lit(2).alias("target"), F.lit(order).alias("order")))
    return found.groupBy("__file").agg(F.min_by(F.struct("begins", "head", "target"), "order").alias("l")).select("__file", "l.*")


def records(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """value (a JSON object in one line) and the ordinal of every record of the first list there is: the root, or under one of the keys."""
    placed = _placed(_pieces(spark, path))
    begins = materialise(_list_begins(placed, keys), "begins")
    rows = placed.join(_small(begins), "__file").where(F.col(S.ROW) >= F.col("begins"))
    shut = rows.where(~F.col("__in") & (F.col("before") == F.col("target")) & (F.col(S.ROW) > F.col("begins")) & F.col("value").rlike(_SCALARS + r"\]"))
    shut = materialise(shut.groupBy("__file").agg(F.min(S.ROW).alias("stops")), "stops")
    rows = rows.join(_small(shut), "__file", "left").where(F.col("stops").isNull() | (F.col(S.ROW) < F.col("stops")))
    own = F.when(F.col(S.ROW) == F.col("begins"), F.expr("substring(value, head + 1)")).otherwise(F.col("value"))
    end = F.col("__shut") & (F.col("after") == F.col("target"))
    along = Window.partitionBy("__file", "__from").orderBy(S.ROW)
    rows = rows.select("__file", "__from", S.ROW, own.alias("value"), end.alias("end"), (F.col(S.ROW) == F.col("begins")).alias("first"))
    rows = materialise(rows.withColumn("alone", F.col("end") & (F.col("first") | F.coalesce(F.lag("end").over(along), F.lit(False)))).withColumn("back", F.last(F.when(F.col("end"), F.col(S.ROW)), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))), "list")
    alone = rows.where("alone").select(S.ROW, F.concat("value", F.lit("}")).alias("value"))
    in_file = Window.partitionBy("__file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__file", "__from").agg(F.max(F.when(F.col("end"), F.col(S.ROW))).alias("last"))
    carried = carried.select("__file", "__from", F.last("last", ignorenulls=True).over(in_file).alias("carried"))
    parts = rows.where("not alone").join(_small(materialise(carried, "carried")), ["__file", "__from"])
    parts = parts.withColumn("group", F.coalesce("back", "carried", F.lit(-1)))
    whole = parts.groupBy("__file", "group").agg(F.sort_array(F.collect_list(F.struct(F.col(S.ROW).alias("row"), "value"))).alias("all"), F.max("end").alias("ended"))
    whole = whole.where("ended").select(F.col("all")[0]["row"].alias(S.ROW), F.concat(F.array_join("all.value", "}"), F.lit("}")).alias("value"))
    text = F.regexp_replace(F.regexp_replace("value", _SCALARS, ""), r"[\r\n]+", " ")
    return alone.unionByName(whole.select(S.ROW, "value")).select(S.ROW, text.alias("value"))


def read(spark: SparkSession, path: str, keys: tuple[str, ...], name: str = "r") -> DataFrame | None:
    """One struct column of the records' fields (all as text, but for lists and objects) and the ordinal; None if there are no records.

    Records are written once, a line each, and read back by as many tasks as they fill."""
    found = records(spark, path, keys)
    out = new_path(spark, "records")
    found.select(F.concat(F.lit(f'{{"{S.ROW}":'), F.col(S.ROW).cast("string"), F.lit(f',"{name}":'), "value", F.lit("}")).alias("value")).write.text(out)
    rows = spark.read.json(out, primitivesAsString=True)
    return rows.select(name, F.col(S.ROW).cast("long").alias(S.ROW)) if name in rows.columns else None
