"""Column vocabularies: alias resolution, output order, Darwin Core names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import first_nonblank, nonblank, pytrim, ref

LOC, CTRY, ID, LAT, LON, AI_LOC = "_loc", "_ctry", "_id", "_lat", "_lon", "_ai_loc"


def with_row(df: DataFrame) -> DataFrame:
    """Adds the input ordinal.  Use it right after the scan, before anything shuffles."""
    return df if S.ROW in df.columns else df.withColumn(S.ROW, F.monotonically_increasing_id())


def locality(columns: Iterable[str]) -> Column:
    return F.coalesce(pytrim(first_nonblank(columns, S.LOCALITY)), F.lit(""))


def country(columns: Iterable[str]) -> Column:
    return F.coalesce(pytrim(first_nonblank(columns, S.COUNTRY)), F.lit(""))


def identifier(columns: Iterable[str], default: str | Column = "Unknown") -> Column:
    return F.coalesce(pytrim(first_nonblank(columns, S.IDENTIFIER)), default if isinstance(default, Column) else F.lit(default))


def given_latitude(columns: Iterable[str]) -> Column:
    return first_nonblank(columns, S.LATITUDE)


def given_longitude(columns: Iterable[str]) -> Column:
    return first_nonblank(columns, S.LONGITUDE)


def verbatim_coordinates(columns: Iterable[str]) -> Column:
    """The verbatim text, then "latitude longitude" if both are there; null if nothing is."""
    whole = pytrim(first_nonblank(columns, S.VERBATIM_COORDINATES))
    lat, lon = pytrim(first_nonblank(columns, S.VERBATIM_LATITUDE)), pytrim(first_nonblank(columns, S.VERBATIM_LONGITUDE))
    pair = F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(" ", lat, lon))
    joined = F.concat_ws("; ", whole, pair)
    return F.when(joined != "", joined)


def prompt_locality(columns: Iterable[str]) -> Column:
    """The locality with the verbatim coordinates as a hint, unless both decimal fields are filled in."""
    columns = list(columns)
    hint = F.when(given_latitude(columns).isNull() | given_longitude(columns).isNull(), F.concat(F.lit("[verbatim coordinates: "), verbatim_coordinates(columns), F.lit("]")))
    return pytrim(F.concat_ws(" ", F.when(locality(columns) != "", locality(columns)), hint))


def resolve(df: DataFrame) -> DataFrame:
    """Adds _loc, _ctry, _id, _lat, _lon and _ai_loc once, so later operators need no aliases."""
    c = df.columns
    return df.withColumns({LOC: locality(c), CTRY: country(c), ID: identifier(c), LAT: given_latitude(c), LON: given_longitude(c), AI_LOC: prompt_locality(c)})


def has_locality_column(columns: Iterable[str]) -> bool:
    lowered = {a.lower() for a in S.LOCALITY}
    return any(c.lower() in lowered or "locality" in c.lower() or "location" in c.lower() for c in columns)


def has_identifier_column(columns: Iterable[str]) -> bool:
    lowered = {a.lower() for a in S.IDENTIFIER}
    return any(c.lower() in lowered or "barcode" in c.lower() or c.lower().endswith("id") for c in columns)


def distinct_names(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def ordered_columns(columns: Iterable[str], darwin_core: bool = False) -> list[str]:
    """Native: input columns, then the produced ones in export order.  Darwin Core: its terms first, then the rest."""
    names = distinct_names(columns)
    if darwin_core:
        terms = [t for t in distinct_names(S.DARWIN_CORE.values()) if t in names]
        return terms + [c for c in names if c not in terms]
    return [c for c in names if c not in S.PRODUCED] + [c for c in S.PRODUCED if c in names]


def darwin_core_columns(columns: Iterable[str]) -> list[str]:
    return distinct_names(S.DARWIN_CORE.get(c, c) for c in columns)


def to_darwin_core(df: DataFrame) -> DataFrame:
    """Rename to Darwin Core terms; where several columns share a term the last non-blank value wins."""
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        sources.setdefault(S.DARWIN_CORE.get(c, c), []).append(c)
    out = []
    for term, columns in sources.items():
        if len(columns) == 1:
            out.append(ref(columns[0]).alias(term))
        else:
            out.append(F.coalesce(*[nonblank(ref(c)) for c in reversed(columns)], ref(columns[0]).cast("string")).alias(term))
    return df.select(*out)
