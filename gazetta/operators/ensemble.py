"""Comparison of two result sets by distance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.geo import category, haversine, validated
from ..functions.text import pytrim, ref
from .resolve import with_row

CATEGORY, DISTANCE = "Ensemble_Category", "Ensemble_Distance_km"


def any_case(columns: Iterable[str], names: Iterable[str]) -> Column:
    """The first filled value: exact names first, then the same names in any case.  Only null and "" are blank."""
    columns, names = list(columns), list(names)
    exact = [n for n in names if n in columns]
    loose = [c for n in names for c in columns if c.lower() == n.lower() and c not in exact]
    there = [F.when(ref(c).cast("string") != "", ref(c).cast("string")) for c in dict.fromkeys(exact + loose)]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def record_key(columns: Iterable[str]) -> Column:
    """The identifier, trimmed; null (which matches nothing) if there is none."""
    key = pytrim(any_case(columns, S.COMPARE_KEY))
    return F.when(key != "", key)


def coordinates(columns: Iterable[str], darwin_core: bool = True) -> Column:
    """struct(lat, lon) or null; with the Darwin Core names too unless told otherwise."""
    extra = (("decimalLatitude",), ("decimalLongitude",)) if darwin_core else ((), ())
    return validated(any_case(columns, S.COMPARE_LATITUDE + extra[0]), any_case(columns, S.COMPARE_LONGITUDE + extra[1]))


def _keyed(df: DataFrame, darwin_core: bool) -> DataFrame:
    rows = with_row(df)
    return rows.withColumn("__key", record_key(df.columns)).withColumn("__at", coordinates(df.columns, darwin_core))


def first_per_key(df: DataFrame) -> DataFrame:
    """df has __key and the ordinal: its first row of each key."""
    columns = [c for c in df.columns if c not in ("__key", S.ROW)]
    return df.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min_by(F.struct(*[ref(c) for c in columns]), F.col(S.ROW)).alias("__r"))


def compare(primary: DataFrame, secondary: DataFrame, darwin_core: bool = True) -> DataFrame:
    """Every primary row with the produced columns of its first secondary match, category and distance (km, 3 places), and the ordinal by which exporters sort."""
    # rows without a key match nothing; keys of their own spread them over the tasks
    left = _keyed(primary, darwin_core).withColumn("__key", F.coalesce("__key", F.concat(F.lit("\0"), F.col(S.ROW))))
    produced = [c for c in S.PRODUCED if c in secondary.columns]
    right = _keyed(secondary, darwin_core).select("__key", S.ROW, "__at", *[ref(c) for c in produced])
    right = first_per_key(right)
    joined = left.join(right, "__key", "left")
    km = F.round(haversine(F.col("__at.lat"), F.col("__at.lon"), F.col("__r")["__at"]["lat"], F.col("__r")["__at"]["lon"]), 3)
    joined = joined.withColumn("__km", km)
    second = [F.coalesce(F.col("__r")[c].cast("string"), F.lit("")).alias(f"Secondary_{c}") for c in produced]
    return joined.select(*[ref(c) for c in primary.columns if c != S.ROW], *second, category(F.col("__km")).alias(CATEGORY), F.col("__km").alias(DISTANCE), F.col("__r").isNotNull().alias("__matched"), S.ROW)


def summarise(compared: DataFrame) -> DataFrame:
    """position, category, n: all five categories in order, zeros too; unknown ones count as no comparison."""
    spark = compared.sparkSession
    names = spark.createDataFrame(list(enumerate(S.CATEGORY_ORDER)), "position int, category string")
    known = F.when(F.col(CATEGORY).isin(*S.CATEGORY_ORDER), F.col(CATEGORY)).otherwise(F.lit(S.NO_COMPARISON))
    counts = compared.groupBy(known.alias("category")).agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).alias("n")).orderBy("position")


def only_primary(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary rows without a match."""
    keys = secondary.select(record_key(secondary.columns).alias("__key")).where("__key is not null").distinct()
    return primary.withColumn("__key", record_key(primary.columns)).join(keys, "__key", "left_anti").drop("__key")


def only_secondary(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Distinct secondary keys that no primary row has."""
    mine = primary.select(record_key(primary.columns).alias("key")).where("key is not null").distinct()
    theirs = secondary.select(record_key(secondary.columns).alias("key")).where("key is not null").distinct()
    return theirs.join(mine, "key", "left_anti")


def duplicate_keys(df: DataFrame, key: Column | None = None) -> DataFrame:
    """One row: rows beyond the first of each key.  Two plain aggregates, so a hot key shrinks in the map tasks."""
    per_key = df.select((record_key(df.columns) if key is None else key).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
