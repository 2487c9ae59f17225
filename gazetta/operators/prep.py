"""Candidates: which records need coordinates, one per place, and the way back to every record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.geo import valid
from ..functions.text import normalised, nonblank, ref
from .resolve import CTRY, ID, LAT, LOC, LON, resolve, with_row

_HELPERS = (LOC, CTRY, ID, LAT, LON, "_ai_loc")


def dedup_key(loc: Column, ctry: Column) -> Column:
    return F.concat(normalised(loc), F.lit("|"), normalised(ctry))


def needs_coordinates(include_existing: bool = False) -> Column:
    """On resolved rows: has a locality and (unless asked otherwise) no valid coordinates."""
    has = F.col(LOC) != ""
    return has if include_existing else has & ~valid(F.col(LAT), F.col(LON))


def filter_records(df: DataFrame, include_existing: bool = False, max_records: int | None = None) -> DataFrame:
    """Rows that need coordinates, in input order; the limit counts rows before any deduplication."""
    out = resolve(with_row(df)).where(needs_coordinates(include_existing))
    return out.orderBy(S.ROW).limit(max_records) if max_records is not None else out


def filter_stats(df: DataFrame, include_existing: bool = False, max_records: int | None = None, deduplicate: bool = True) -> DataFrame:
    """One row: total, with_locality, with_valid_coordinates, selected, groups, duplicates_removed."""
    rows = resolve(with_row(df))
    needed = needs_coordinates(include_existing)
    counts = rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(LOC) != "").alias("with_locality"),
        F.count_if(valid(F.col(LAT), F.col(LON))).alias("with_valid_coordinates"),
        F.count_if(needed).alias("needed"),
    )
    selected = F.col("needed") if max_records is None else F.least("needed", F.lit(max_records).cast("long"))
    chosen = filter_records(df, include_existing, max_records)
    groups = chosen.select(normalised(F.col(LOC)).alias("l"), normalised(F.col(CTRY)).alias("c")).distinct().agg(F.count("*").alias("groups"))
    if not deduplicate:
        groups = rows.agg(F.lit(None).cast("long").alias("groups"))
    # two single rows meet in a scalar join
    out = counts.withColumn("one", F.lit(1)).join(F.broadcast(groups.withColumn("one", F.lit(1))), "one").withColumn("selected", selected)
    out = out.withColumn("groups", F.coalesce("groups", "selected"))
    return out.select("total", "with_locality", "with_valid_coordinates", "selected", "groups", (F.col("selected") - F.col("groups")).alias("duplicates_removed"))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row per place: the first full record, its ordinal (by which exporters sort), the place's key, the distinct ids in order, the count.

    First records are picked in the map tasks before any is sent; ids and counts are gathered apart from them."""
    rows = df if LOC in df.columns else resolve(with_row(df))
    place = [normalised(F.col(LOC)).alias("__l"), normalised(F.col(CTRY)).alias("__c")]
    own = [c for c in rows.columns if c != S.ROW]
    firsts = rows.select(*place, F.col(S.ROW), F.struct(*[ref(c) for c in own]).alias("__own")).groupBy("__l", "__c").agg(F.min_by("__own", S.ROW).alias("__own"), F.min(S.ROW).alias(S.ROW))
    slim = rows.select(*place, F.col(S.ROW).alias("__row"), nonblank(F.when(F.col(ID) != "Unknown", F.col(ID))).alias("__id"))
    per_id = slim.groupBy("__l", "__c", "__id").agg(F.min("__row").alias("__at"), F.count("*").alias("__n"))  # hot places shrink in the map tasks
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__id").isNotNull(), F.struct("__at", "__id")))), lambda x: x["__id"])
    groups = per_id.groupBy("__l", "__c").agg(ids.alias(S.OCCURRENCE_IDS), F.sum("__n").alias(S.OCCURRENCE_COUNT))
    out = firsts.join(groups, ["__l", "__c"])
    return out.select(S.ROW, *[F.col("__own")[c].alias(c) for c in own], F.concat("__l", F.lit("|"), "__c").alias(S.DEDUP_KEY), S.OCCURRENCE_IDS, S.OCCURRENCE_COUNT)


def tracking_as_text(df: DataFrame) -> DataFrame:
    """Ids joined by | and the count as text, as delimited files hold them."""
    return df.withColumn(S.OCCURRENCE_IDS, F.array_join(S.OCCURRENCE_IDS, "|")).withColumn(S.OCCURRENCE_COUNT, F.col(S.OCCURRENCE_COUNT).cast("string"))


def without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*_HELPERS, S.ROW)


def expand(original: DataFrame, processed: DataFrame, protect_existing: bool = False) -> DataFrame:
    """Results back onto every original row.

    Of processed rows with the same place the last wins, by their ordinal if they have one.  A matched row takes every produced column that the result
    has, also blank ones; others keep their own.  ``protect_existing`` keeps valid coordinates of the original.
    Adds __matched; the number of rows stays, and the ordinal by which exporters sort."""
    left = with_row(original)
    c = left.columns
    left_resolved = resolve(left)
    right = resolve(with_row(processed))
    produced = [p for p in S.PRODUCED if p in processed.columns]
    last = right.where(F.col(LOC) != "").groupBy(dedup_key(F.col(LOC), F.col(CTRY)).alias("__key")).agg(F.max_by(F.struct(*[ref(p) for p in produced], F.lit(1).alias("__hit")), F.col(S.ROW)).alias("__new"))
    # rows without a locality match nothing; keys of their own spread them over the tasks
    key = F.when(F.col(LOC) != "", dedup_key(F.col(LOC), F.col(CTRY))).otherwise(F.concat(F.lit("\0"), F.col(S.ROW)))
    joined = left_resolved.withColumn("__key", key).join(last, "__key", "left")
    hit = F.col("__new").isNotNull()
    keep = hit & ~(valid(F.col(LAT), F.col(LON)) & F.lit(protect_existing))
    out = []
    for name in [x for x in c if x != S.ROW] + [p for p in produced if p not in c]:
        own = ref(name) if name in c else F.lit(None).cast("string")
        if name in produced:
            take = keep if name in ("Latitude", "Longitude", "Coordinate_Source", "Coordinate_Radius_Meters") else hit
            own = F.when(take, F.col("__new")[name].cast("string")).otherwise(own.cast("string"))
        out.append(own.alias(name))
    return joined.select(*out, hit.alias("__matched"), S.ROW)


def expand_stats(expanded: DataFrame) -> DataFrame:
    return expanded.agg(F.count("*").alias("total"), F.count_if("__matched").alias("matched"), F.count_if(~F.col("__matched")).alias("unmatched"))
