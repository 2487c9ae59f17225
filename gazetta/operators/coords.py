"""The best coordinates known before a model is asked, and how they are put to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.geo import grid_parts, grid_references, validated, with_grid_latlon
from ..functions.positions import positions
from .resolve import AI_LOC, LAT, LOC, LON, resolve, with_row

PRE = ("pre_source", "pre_lat", "pre_lon", "pre_radius", "pre_confidence", "pre_grid_ref")


def convert_references(df: DataFrame, ref_col: str, datum: str = "offset") -> DataFrame:
    """Adds easting, northing, lat, lon, radius of a column with one grid reference; null where it names no square."""
    parts = df.withColumn("__p", grid_parts(F.col(ref_col)))
    parts = parts.withColumn("easting", F.col("__p.easting")).withColumn("northing", F.col("__p.northing")).withColumn("radius", F.col("__p.radius"))
    return with_grid_latlon(parts.drop("__p"), "easting", "northing", datum=datum)


def preprocess(df: DataFrame, datum: str = "offset") -> DataFrame:
    """Adds pre_source, pre_lat, pre_lon, pre_radius, pre_confidence, pre_grid_ref.

    Valid given coordinates come first, then the first grid reference in the locality that converts, then the first position
    in degrees, minutes and seconds in the locality or the verbatim coordinates; otherwise the row needs a model.  Row-wise:
    no shuffle."""
    rows = df if LOC in df.columns else resolve(with_row(df))
    rows = rows.withColumn("__given", validated(F.col(LAT), F.col(LON)))
    refs = F.filter(F.transform(grid_references(F.col(LOC)), lambda r: F.struct(r.alias("ref"), grid_parts(r).alias("p"))), lambda x: x["p"].isNotNull())
    rows = rows.withColumn("__grid", F.when(F.col("__given").isNull(), F.get(refs, F.lit(0))))
    rows = rows.withColumn("__e", F.col("__grid.p.easting")).withColumn("__n", F.col("__grid.p.northing"))
    rows = with_grid_latlon(rows, "__e", "__n", "__glat", "__glon", datum)
    given, grid = F.col("__given").isNotNull(), F.col("__grid").isNotNull()
    rows = rows.withColumn("__dms", F.when(~given & ~grid, F.get(positions(F.col(AI_LOC) if AI_LOC in rows.columns else F.col(LOC)), F.lit(0))))
    dms = F.col("__dms").isNotNull()
    return rows.select(
        *df.columns,
        F.when(given, F.lit("coordinates_provided")).when(grid, F.lit("grid_reference_converted")).when(dms, F.lit("coordinates_extracted")).otherwise(F.lit("needs_ai_processing")).alias("pre_source"),
        F.when(given, F.col("__given.lat")).otherwise(F.coalesce("__glat", "__dms.lat")).alias("pre_lat"),
        F.when(given, F.col("__given.lon")).otherwise(F.coalesce("__glon", "__dms.lon")).alias("pre_lon"),
        F.col("__grid.p.radius").alias("pre_radius"),
        F.when(given | grid | dms, F.lit("high")).otherwise(F.lit("unknown")).alias("pre_confidence"),
        F.col("__grid.ref").alias("pre_grid_ref"),
    )


def prompt_context() -> Column:
    """The text that tells a model of known coordinates; on preprocessed rows."""
    place = F.format_string("%.6f, %.6f", "pre_lat", "pre_lon")
    given = F.concat(F.lit("\n\nThe record comes with the position "), place, F.lit(". Return it unchanged."))
    radius = F.when(F.col("pre_radius") > 0, F.concat(F.lit("\nIts square gives a radius of "), F.format_string("%.1f", "pre_radius"), F.lit(" m for coordinate_radius_meters."))).otherwise(F.lit(""))
    grid = F.concat(F.lit("\n\nThe grid reference "), F.col("pre_grid_ref"), F.lit(" was converted to "), place, F.lit("."), radius, F.lit("\nReturn this position unchanged; it is computed."))
    written = F.concat(F.lit("\n\nThe record's text holds the position "), place, F.lit(", converted from degrees and minutes. Return it unchanged."))
    none = F.lit("\n\nThe record has no position. Derive one from the locality where that is possible.")
    return F.when(F.col("pre_source") == S.COORDINATE_SOURCES[0], given).when(F.col("pre_source") == S.COORDINATE_SOURCES[1], grid).when(F.col("pre_source") == S.COORDINATE_SOURCES[2], written).otherwise(none)


def prompt(instructions: str, loc: Column, ctry: Column, context: Column) -> Column:
    """The whole prompt of a row.  The instructions are one literal of the plan, not a column."""
    return F.concat(F.lit(instructions), F.lit("\n\nLocality: "), loc, F.lit("\nCountry: "), ctry, context)


_read: dict[str, str] = {}


def instructions(spark: SparkSession, path: str) -> str:
    """The text of an instruction file, read once a session."""
    if path not in _read:
        _read[path] = spark.read.text(path, wholetext=True).first().value
    return _read[path]
