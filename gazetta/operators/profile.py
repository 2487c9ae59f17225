"""Profiles and reports of a data set."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import first_nonblank, ref
from .resolve import has_locality_column, with_row

SAMPLE_ROWS = 100


def bucket_counts(df: DataFrame, column: str, buckets: Iterable[str], fallback: str) -> DataFrame:
    """value, n, percent: all buckets in order, zeros too; null and other values count to the fallback."""
    buckets = list(buckets)
    value = F.when(ref(column).isin(*buckets), ref(column)).otherwise(F.lit(fallback))
    names = df.sparkSession.createDataFrame(list(enumerate(buckets)), "position int, value string")
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    out = names.join(counts, "value", "left").select("position", "value", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(_all())
    return out.withColumn("percent", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 1)).otherwise(F.lit(0.0)))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over a handful of buckets


def source_counts(df: DataFrame, column: str = "Coordinate_Source") -> DataFrame:
    return bucket_counts(df, column, S.COORDINATE_SOURCES, "no_coordinates")


def confidence_counts(df: DataFrame, column: str = "Confidence") -> DataFrame:
    return bucket_counts(df, column, S.CONFIDENCES, "unknown")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent of the total, whatever the values."""
    counts = df.groupBy(ref(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))


def size_of(columns: Iterable[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.length(ref(c).cast("string")), F.lit(0))
    return out


def statistics(df: DataFrame) -> DataFrame:
    """One row: total_records, field_count, field_names, has_latitude, has_longitude, has_coordinates, has_locality,
    avg_locality_length (over the first hundred rows), estimated_size_mb."""
    names = sorted(c for c in df.columns if c != S.ROW)
    low = [c.lower() for c in names]
    lat, lon = any("latitude" in c or c == "lat" for c in low), any("longitude" in c or c in ("lon", "long") for c in low)
    rows = with_row(df)
    loc = first_nonblank(names, S.LOCALITY)
    head = rows.select(S.ROW, loc.alias("loc")).orderBy(S.ROW).limit(SAMPLE_ROWS).agg(F.coalesce(F.avg(F.length("loc")).cast("int"), F.lit(0)).alias("avg_locality_length"))
    total = rows.agg(F.count("*").alias("total_records"), (F.coalesce(F.sum(size_of(names)), F.lit(0)) / F.lit(1024 * 1024.0)).alias("estimated_size_mb"))
    one = total.withColumn("one", F.lit(1)).join(F.broadcast(head.withColumn("one", F.lit(1))), "one").drop("one")
    flags = {"field_count": len(names), "has_latitude": lat, "has_longitude": lon, "has_coordinates": lat and lon, "has_locality": has_locality_column(names)}
    return one.withColumns({k: F.lit(v) for k, v in flags.items()} | {"field_names": F.array(*[F.lit(n) for n in names])})


def sample(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k random rows without replacement: a top-k by a random number, no full sort."""
    return df.orderBy(F.rand(seed)).limit(k)


def preview(df: DataFrame, k: int = 10) -> DataFrame:
    return df.limit(k)


def report(df: DataFrame, output: str, model: str, seconds: float) -> str:
    """The text of a summary report."""
    total = df.count()
    sources = source_counts(df).orderBy("position").collect()
    levels = confidence_counts(df).orderBy("position").collect()
    lines = ["PROCESSING SUMMARY", f"Output: {output}", f"Model: {model}", f"Records: {total:,}", f"Minutes: {seconds / 60:.1f}", "Coordinate sources:"]
    lines += [f"  {r.value}: {r.n:,} ({r.percent:.1f}%)" for r in sources] + ["Confidence:"]
    return "\n".join(lines + [f"  {r.value}: {r.n:,} ({r.percent:.1f}%)" for r in levels])
