"""Elevations in text: quantities and ranges with units, in metres.

A quantity counts as an elevation if a word such as `elev.` or `alt.` stands before it, `a.s.l.` or the like after it, or if
nothing makes it a distance (a direction, `from` or `of` behind it) or a depth.  Named ones go before bare ones.  Ranges
become their midpoint; what lies outside -500 to 9000 m is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT_M = 0.3048
LEAST_M, MOST_M = -500.0, 9000.0
_NUMBER = r"\d{1,3}(?:[,' ]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?"
_METRES, _FEET = r"m(?:et(?:re|er)s?|trs?)?\b\.?+", r"(?:feet|foot|ft)\b\.?+|['′](?!['′\d])"
_SPAN = r"\s*(?:-|–|—|\bto\b|\band\b)\s*"
_QUANTITY = rf"(?<![\d.,\p{{L}}-])(?:ca\.?|c\.|about|~)?\s*(-?(?:{_NUMBER}))\s*(?:({_METRES}|{_FEET})?{_SPAN}({_NUMBER}))?\s*({_METRES}|{_FEET})"
_NAMED = r"(?:elev(?:ation|ations|\.)?|alt(?:itude|itudes|\.)?|height|asl|a\.\s?s\.\s?l\.?)"
_BEFORE = rf"(?:\b{_NAMED}\s*(?:[:=]|of|is|at|ca\.?|c\.|about|\()*\s*)"
_AFTER = rf"\s*\(?(?:\b(?:elev|alt)|a\.?\s?s\.?\s?l\b|(?:above|over)\s+(?:mean\s+)?sea|of\s+(?:elevation|altitude))"
_AWAY = r"(?:\s*(?:\b(?:[NSEW]|[NS][EW]|[NSEW][NS][EW])\b|\b(?:north|south|east|west|from|of|off|away|deep|depth|below|down|up|inland|wide|long|tall|high|square|/|apart)))"
_DEPTH = r"(?:\b(?:depth|deep|below)\s*(?:[:=]|of)?\s*)"
_FLAGS = "(?iu)"
NAMED = f"{_FLAGS}(?:{_BEFORE}{_QUANTITY}|{_QUANTITY}(?={_AFTER}))"
BARE = f"{_FLAGS}(?<!\\b(?:depth|deep|below)[\\s:=]{{0,3}}){_QUANTITY}(?!{_AWAY})"


def _metres(number: Column, unit: Column) -> Column:
    value = F.regexp_replace(number, "[,' ]", "").try_cast("double")
    return F.when(unit.rlike("(?i)^(f|['′])"), value * FOOT_M).otherwise(value)


def _read(whole: Column) -> Column:
    """struct(original, low, high, meters) of a matched quantity, in metres; null out of range."""
    return F.get(F.transform(F.array(F.split(F.regexp_replace(whole, f"{_FLAGS}^.*?({_QUANTITY}).*$", "$1|$2|$3|$4|$5"), r"\|")), _checked), F.lit(0))


def _checked(parts: Column) -> Column:
    first, unit_1, second, unit = (F.get(parts, F.lit(k)) for k in (1, 2, 3, 4))
    low = _metres(first, F.when(unit_1 != "", unit_1).otherwise(unit))
    high = F.when(second != "", _metres(second, unit)).otherwise(low)
    good = low.between(LEAST_M, MOST_M) & high.between(LEAST_M, MOST_M) & (low <= high)
    return F.when(good, F.struct(F.btrim(F.get(parts, F.lit(0))).alias("original"), low.alias("low"), high.alias("high"), ((low + high) / 2).alias("meters")))


def elevation(text: Column) -> Column:
    """struct(original, low, high, meters) of the first elevation named as such, else of the first bare one; null if none."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (NAMED, BARE)])
    return F.get(F.filter(F.transform(found, _read), lambda e: e.isNotNull()), F.lit(0))
