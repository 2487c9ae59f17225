"""Coordinates: validity, great-circle distance, grid references and their conversion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORIES, NO_COMPARISON
from .text import SPACE, number, pytrim

EARTH_KM = 6371.0
#: Patterns of grid references, in order of precedence (Java flags: case, Unicode case and classes).
GRID_PATTERNS = (
    r"(?iuU)\b[A-Z]{2}(?:\s?/?\s?)?(?:[0-9]{2}\s?[0-9]{2}|[0-9]{3}\s?[0-9]{3}|[0-9]{4}\s?[0-9]{4}|[0-9]{5}\s?[0-9]{5})\b",
    r"(?iuU)\b[HJNOST][0-9]{6,10}\b",
    r"(?iuU)\bgrid\s+ref[a-z]*[:\s]+[A-Z]{1,2}[0-9\s]{4,12}\b",
    r"(?iuU)\bGR[:\s]+[A-Z]{1,2}[0-9\s]{4,12}\b",
)
#: Letters of the National Grid: no I.
GRID_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"
#: The squares of the National Grid that hold land.
GRID_SQUARES = (
    "HP HT HU HW HX HY HZ NA NB NC ND NF NG NH NJ NK NL NM NN NO NR NS NT NU NW NX NY NZ OV SC SD SE SH SJ SK SM SN SO SP SR SS ST SU SV SW SX SY SZ "
    "TA TF TG TL TM TQ TR TV"
).split()
#: Airy 1830 and the National Grid's true origin; the constant shift towards WGS84 (degrees).
AIRY_A, AIRY_B, SCALE = 6377563.396, 6356256.909, 0.9996012717
ORIGIN_LAT, ORIGIN_LON, ORIGIN_N, ORIGIN_E = math.radians(49), math.radians(-2), -100000.0, 400000.0
SHIFT_LAT, SHIFT_LON = 0.0015, 0.0009
#: OSGB36 to WGS84, seven parameters (m, ppm, arc seconds) and the WGS84 ellipsoid.
HELMERT = (446.448, -125.157, 542.060, -20.4894, 0.1502, 0.2470, 0.8421)
WGS84_A, WGS84_B = 6378137.0, 6356752.3142
_ROUNDS = 5


def valid(lat: Column, lon: Column) -> Column:
    """Both parse as numbers and lie in range; never null."""
    a, b = number(lat), number(lon)
    return F.coalesce(a.between(-90, 90) & b.between(-180, 180), F.lit(False))


def validated(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), or null if either is bad."""
    return F.when(valid(lat, lon), F.struct(number(lat).alias("lat"), number(lon).alias("lon")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))  # null stays null


def category(km: Column) -> Column:
    """Agreement category of a distance; the upper bound of each is open."""
    out = F.lit(CATEGORIES[-1][0])
    for name, under in reversed(CATEGORIES[:-1]):
        out = F.when(km < under, F.lit(name)).otherwise(out)
    return F.when(km.isNull(), F.lit(NO_COMPARISON)).otherwise(out)


def grid_references(text: Column) -> Column:
    """Distinct grid references in a text, by pattern and then by place."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in GRID_PATTERNS])))


def grid_parts(ref: Column) -> Column:
    """struct(easting, northing, radius) of the centre of the square that a reference names, or null."""
    clean = F.upper(pytrim(ref))
    clean = F.regexp_replace(clean, r"^(GRID\s+REF[A-Z]*|GR)[:\s]+", "")
    clean = F.regexp_replace(clean, f"({SPACE}|/)+", "")
    digits = F.substring(clean, 3, 10)
    half = (F.length(digits) / 2).cast("int")
    size = F.pow(F.lit(10.0), 5 - half)
    a, b = _letter(clean, 1), _letter(clean, 2)
    east = ((a - 2) % 5) * 5 + b % 5
    north = 19 - F.floor(a / 5) * 5 - F.floor(b / 5)
    ok = clean.rlike("^[A-Z]{2}[0-9]{4,10}$") & (F.length(digits) % 2 == 0) & F.substring(clean, 1, 2).isin(*GRID_SQUARES)
    easting = east * 100000 + F.substring(digits, F.lit(1), half).try_cast("double") * size + size / 2
    northing = north * 100000 + F.substring(digits, half + 1, half).try_cast("double") * size + size / 2
    return F.when(ok, F.struct(easting.cast("double").alias("easting"), northing.cast("double").alias("northing"), (size * math.sqrt(2) / 2).alias("radius")))


def _letter(text: Column, i: int) -> Column:
    return F.instr(F.lit(GRID_LETTERS), F.substring(text, i, 1)) - 1


def with_grid_latlon(df: DataFrame, easting: str, northing: str, lat: str = "lat", lon: str = "lon", datum: str = "offset") -> DataFrame:
    """Adds lat and lon (degrees) of National Grid columns.

    The inverse transverse Mercator series as a chain of projections: five rounds for the footpoint latitude, then the
    series in the distance from the meridian.  ``datum``: a constant shift, or the published seven-parameter one."""
    a, b = AIRY_A, AIRY_B
    n = (a - b) / (a + b)
    e2 = 1 - (b * b) / (a * a)
    c0, c1 = 1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3
    c2, c3 = 15 / 8 * (n**2 + n**3), 35 / 24 * n**3
    north = F.col(northing) - ORIGIN_N
    df = df.withColumn("__phi", north / (a * SCALE) + ORIGIN_LAT)
    for _ in range(_ROUNDS):
        d, s = F.col("__phi") - ORIGIN_LAT, F.col("__phi") + ORIGIN_LAT
        arc = b * SCALE * (c0 * d - c1 * F.sin(d) * F.cos(s) + c2 * F.sin(2 * d) * F.cos(2 * s) - c3 * F.sin(3 * d) * F.cos(3 * s))
        df = df.withColumn("__arc", arc).withColumn("__phi", F.col("__phi") + (north - F.col("__arc")) / (a * SCALE))
    phi = F.col("__phi")
    df = df.withColumn("__w", 1 - e2 * F.pow(F.sin(phi), 2)).withColumn("__nu", a * SCALE / F.sqrt("__w"))
    df = df.withColumn("__rho", a * SCALE * (1 - e2) * F.pow("__w", F.lit(-1.5))).withColumn("__eta", F.col("__nu") / F.col("__rho") - 1).withColumn("__t", F.tan(phi))
    nu, rho, eta, t, x, sec = F.col("__nu"), F.col("__rho"), F.col("__eta"), F.col("__t"), F.col(easting) - ORIGIN_E, 1 / F.cos(phi)
    t2, t4, t6 = F.pow(t, 2), F.pow(t, 4), F.pow(t, 6)
    lat_rad = phi - t / (2 * rho * nu) * F.pow(x, 2) + t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t2 + eta - 9 * t2 * eta) * F.pow(x, 4) - t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t4) * F.pow(x, 6)
    lon_rad = ORIGIN_LON + sec / nu * x - sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t2) * F.pow(x, 3) + sec / (120 * F.pow(nu, 5)) * (5 + 28 * t2 + 24 * t4) * F.pow(x, 5) - sec / (5040 * F.pow(nu, 7)) * (61 + 662 * t2 + 1320 * t4 + 720 * t6) * F.pow(x, 7)
    df = df.withColumn("__lat", lat_rad).withColumn("__lon", lon_rad)
    if datum == "helmert":
        df = _helmert(df)
        shift_lat = shift_lon = 0.0
    else:
        shift_lat, shift_lon = SHIFT_LAT, SHIFT_LON
    df = df.withColumn(lat, F.degrees("__lat") + shift_lat).withColumn(lon, F.degrees("__lon") + shift_lon)
    return df.drop("__phi", "__arc", "__w", "__nu", "__rho", "__eta", "__t", "__lat", "__lon")


def _helmert(df: DataFrame) -> DataFrame:
    """Columns __lat, __lon (radians, Airy) to the same on WGS84 at height 0."""
    tx, ty, tz, ppm, rx, ry, rz = HELMERT
    s, (rx, ry, rz) = 1 + ppm * 1e-6, (math.radians(r / 3600) for r in (rx, ry, rz))
    e2 = 1 - (AIRY_B / AIRY_A) ** 2
    nu = AIRY_A / F.sqrt(1 - e2 * F.pow(F.sin("__lat"), 2))
    df = df.withColumn("__x", nu * F.cos("__lat") * F.cos("__lon")).withColumn("__y", nu * F.cos("__lat") * F.sin("__lon")).withColumn("__z", nu * (1 - e2) * F.sin("__lat"))
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    df = df.select("*", (tx + s * x - rz * y + ry * z).alias("__x2"), (ty + rz * x + s * y - rx * z).alias("__y2"), (tz - ry * x + rx * y + s * z).alias("__z2"))
    w2 = 1 - (WGS84_B / WGS84_A) ** 2
    df = df.withColumn("__p", F.hypot("__x2", "__y2")).withColumn("__lat", F.atan2(F.col("__z2"), F.col("__p") * (1 - w2)))
    for _ in range(_ROUNDS):
        v = WGS84_A / F.sqrt(1 - w2 * F.pow(F.sin("__lat"), 2))
        df = df.withColumn("__lat", F.atan2(F.col("__z2") + w2 * v * F.sin("__lat"), F.col("__p")))
    return df.withColumn("__lon", F.atan2("__y2", "__x2")).drop("__x", "__y", "__z", "__x2", "__y2", "__z2", "__p")
