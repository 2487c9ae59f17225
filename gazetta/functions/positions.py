"""Positions written in degrees, minutes and seconds: found in text, checked and made decimal.

The grammar: an angle is a number with a degree mark, then perhaps minutes and seconds with theirs, and a hemisphere before
or after it; a position is two angles, one of them a latitude, with nothing between them but separators.  Only the last
number of an angle may have decimals (a point or a comma); minutes and seconds are under 60."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

_NUMBER = r"\d{1,2}(?:[.,]\d+)?"
_DEGREE = r"\s*(?:[°º˚⁰]|deg(?:rees?)?\b\.?|d(?![a-z]))\s*"
_MINUTE = r"\s*(?:['′’ʹ´`](?!['′’ʹ´`])|min(?:utes?)?\b\.?|m(?![a-z]))\s*"
_SECOND = r"\s*(?:[\"″”“ʺ]|['′’ʹ´`]{2}|sec(?:onds?)?\b\.?|s(?![a-z]))"
_BODY = rf"\d{{1,3}}(?:[.,]\d+)?{_DEGREE}(?:{_NUMBER}(?:{_MINUTE}(?:{_NUMBER}{_SECOND})?)?(?![\d.,]*\d))?"
_SIDE = r"(?:North|South|East|West|[NSEW])"
#: An angle: its hemisphere stands before it or after it.
ANGLE = rf"(?iu)(?:(?<![\p{{L}}\d.,]){_SIDE}\.?:?\s*{_BODY}|(?<![\p{{L}}\d.,]){_BODY}\s*{_SIDE}(?![\p{{L}}]))"
_BETWEEN = r"(?:[\s,;:/|&()\[\].=-]|\band\b|\blat(?:itude)?\b|\blong?(?:itude)?\b)*"
POSITION = f"{ANGLE}{_BETWEEN}{ANGLE.removeprefix('(?iu)')}"


_DIGITS = r"(\d+(?:[.,]\d+)?)"
#: The parts of an angle: side, degrees, minutes, seconds, side.
_PARTS = rf"(?iu)^({_SIDE})?\.?:?\s*{_DIGITS}{_DEGREE}(?:{_DIGITS}(?:{_MINUTE}(?:{_DIGITS}{_SECOND})?)?)?\s*({_SIDE})?$"


def angle(text: Column) -> Column:
    """struct(value in degrees, side N S E W, unit: what the last digit written is worth in degrees) of one angle; null
    if its parts are out of range or a number before the last has decimals."""
    split = F.split(F.replace(F.regexp_replace(text, _PARTS, "$1$5|$2|$3|$4"), F.lit(","), F.lit(".")), r"\|")
    return F.get(F.transform(F.array(split), _checked), F.lit(0))


def _checked(parts: Column) -> Column:
    side, (deg, minutes, seconds) = F.upper(F.substring(parts[0], 1, 1)), (F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i in (1, 2, 3))
    last = F.coalesce(seconds, minutes, deg)
    worth = F.when(seconds.isNotNull(), F.lit(3600.0)).when(minutes.isNotNull(), F.lit(60.0)).otherwise(F.lit(1.0))
    unit = F.pow(F.lit(10.0), -F.when(last.contains("."), F.length(last) - F.instr(last, ".")).otherwise(0)) / worth
    whole = (minutes.isNull() | ~deg.contains(".")) & (seconds.isNull() | ~minutes.contains("."))
    m, s = (F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in (minutes, seconds))
    value = deg.try_cast("double") + m / 60 + s / 3600
    most = F.when(side.isin("N", "S"), F.lit(90.0)).otherwise(F.lit(180.0))
    good = whole & (m < 60) & (s < 60) & (value <= most)
    return F.when(good, F.struct(F.when(side.isin("S", "W"), 0 - value).otherwise(value).alias("value"), side.alias("side"), unit.alias("unit")))


def _of(angles: Column, sides: str) -> Column:
    """The first angle of these sides."""
    return F.get(F.filter(angles, lambda a: a["side"].isin(*sides)), F.lit(0))


def _position(whole: Column, lat: Column, lon: Column) -> Column:
    good = lat.isNotNull() & lon.isNotNull()
    return F.when(good, F.struct(whole.alias("text"), lat["value"].alias("lat"), lon["value"].alias("lon"), F.greatest(lat["unit"], lon["unit"]).alias("unit")))


def positions(text: Column) -> Column:
    """array of struct(text, lat, lon, unit) of all positions in a text that are in range, in order; unit: the coarser of
    what the last digits of both angles are worth, in degrees."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(POSITION), F.lit(0))

    def read(whole: Column) -> Column:
        return once(F.transform(F.regexp_extract_all(whole, F.lit(ANGLE), F.lit(0)), angle), lambda both: once(F.struct(_of(both, "NS").alias("lat"), _of(both, "EW").alias("lon")), lambda p: _position(whole, p["lat"], p["lon"])))

    return F.filter(F.transform(found, read), lambda p: p.isNotNull())
