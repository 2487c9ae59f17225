"""Registered queries of the operators that read facts from free text: repair, positions, elevations, names.

The driver's tables hold no such texts, so each query writes them from whole tables in a way that both sides spell out; the
SQL gives the facts from the tables' numbers, without parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import elevation, positions, repair
from ..operators import coords, gazetteer
from .queries import _t, query

# --- repair ----------------------------------------------------------------------------------------------------------


def _damaged(text: Column) -> Column:
    """UTF-8 bytes read as Windows-1252."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), repair._CONTROL, repair._SPECIAL)


@query("SELECT doc_id, md5(text || ' 7° „é“ & 漢') AS digest, false AS suspicious FROM documents")
def mended_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts as they are, a third damaged once, a third twice; references in all."""
    text, third = F.concat("text", F.lit(" 7° „é“ & 漢")), F.col("doc_id") % 3
    hurt = F.when(third == 0, text).when(third == 1, _damaged(text)).otherwise(_damaged(_damaged(text)))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.replace(hurt, F.lit(" & "), F.lit(" &amp; ")).alias("t"))
    mended = repair.remade(repair.unreferenced(F.col("t")))
    return docs.select("doc_id", mended.alias("m")).select("doc_id", F.md5(F.col("m").cast("binary")).alias("digest"), repair.suspicious(F.col("m")).alias("suspicious"))


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(text || ' &deg;C &bogus; ° ', '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g')).replace('&deg;', '°')) AS digest FROM conversations WHERE NOT contains(text, '&')")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, encoding and white space in one expression."""
    rows = _t(spark, sf_dir, "conversations").where(~F.col("text").contains("&"))
    return rows.select("conv_id", "turn", F.md5(repair.cleaned(F.concat("text", F.lit(" &deg;C &bogus; &#176; "))).cast("binary")).alias("digest"))


# --- positions -------------------------------------------------------------------------------------------------------

_ANGLES = """a AS (SELECT c_custkey AS k, c_custkey % 90 AS d1, (c_custkey * 7) % 61 AS m1, (c_custkey * 13) % 600 AS s1, (c_custkey * 3) % 181 AS d2, (c_custkey * 11) % 60 AS m2, (c_custkey * 17) % 600 AS s2 FROM customer),
v AS (SELECT *, CASE k % 4 WHEN 0 THEN d1 + m1 / 60.0 + s1 / 36000.0 WHEN 1 THEN d1 + m1 / 60.0 WHEN 2 THEN d1 + m1 / 60.0 + s1 / 36000.0 ELSE d1 + s1 / 1000.0 END AS lat,
  CASE k % 4 WHEN 0 THEN d2 + m2 / 60.0 + s2 / 36000.0 WHEN 1 THEN d2 + m2 / 60.0 WHEN 2 THEN d2 + m2 / 60.0 + s2 / 36000.0 ELSE d2 + s2 / 1000.0 END AS lon FROM a),
p AS (SELECT *, lat <= 90 AND lon <= 180 AND (m1 < 60 OR k % 4 = 3) AS ok FROM v)"""


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a = _t(spark, sf_dir, "customer").select(k.alias("k"), (k % 90).alias("d1"), (k * 7 % 61).alias("m1"), (k * 13 % 600).alias("s1"), (k * 3 % 181).alias("d2"), (k * 11 % 60).alias("m2"), (k * 17 % 600).alias("s2"), "c_name")

    def tenths(s: str) -> Column:
        return F.concat((F.col(s) / 10).cast("long").cast("string"), F.lit("."), (F.col(s) % 10).cast("string"))

    def thousandths(s: str) -> Column:
        return F.lpad(F.col(s).cast("string"), 3, "0")

    c = F.concat
    forms = [
        c("d1", F.lit("°"), "m1", F.lit("'"), tenths("s1"), F.lit('"N '), "d2", F.lit("°"), "m2", F.lit("'"), tenths("s2"), F.lit('"W')),
        c(F.lit("lat. S "), "d1", F.lit("º "), "m1", F.lit("′, long. E "), "d2", F.lit("º "), "m2", F.lit("′")),
        c("d2", F.lit(" deg "), "m2", F.lit(" min "), F.replace(tenths("s2"), F.lit("."), F.lit(",")), F.lit(" sec East / "), "d1", F.lit(" deg "), "m1", F.lit(" min "), F.replace(tenths("s1"), F.lit("."), F.lit(",")), F.lit(" sec North")),
        c("d1", F.lit("."), thousandths("s1"), F.lit("°N; "), "d2", F.lit("."), thousandths("s2"), F.lit("° W")),
    ]
    form = F.when(k0 := F.col("k") % 4 == 0, forms[0]).when(F.col("k") % 4 == 1, forms[1]).when(F.col("k") % 4 == 2, forms[2]).otherwise(forms[3])
    return a.select("k", F.when(k0.isNotNull(), c(F.lit("Collected near "), "c_name", F.lit(", "), form, F.lit(", 5 km N of it, 300 m"))).alias("text"))


@query(f"""WITH {_ANGLES} SELECT k, CASE WHEN ok THEN 1 ELSE 0 END AS n, CASE WHEN ok THEN round(CASE WHEN k % 4 = 1 THEN 0 - lat ELSE lat END, 8) END AS lat,
  CASE WHEN ok THEN round(CASE WHEN k % 4 IN (0, 3) THEN 0 - lon ELSE lon END, 8) END AS lon, CASE WHEN ok THEN round(CASE k % 4 WHEN 1 THEN 1 / 60.0 WHEN 3 THEN 0.001 ELSE 1 / 36000.0 END, 8) END AS unit FROM p""")
def written_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, minutes and seconds in four ways of writing; angles out of range are none."""
    found = _angles(spark, sf_dir).select("k", positions.positions(F.col("text")).alias("p"))
    first = F.get("p", F.lit(0))
    return found.select("k", F.size("p").alias("n"), F.round(first["lat"], 8).alias("lat"), F.round(first["lon"], 8).alias("lon"), F.round(first["unit"], 8).alias("unit"))


@query(f"""WITH {_ANGLES} SELECT k, CASE WHEN ok THEN 'coordinates_extracted' ELSE 'needs_ai_processing' END AS source, CASE WHEN ok THEN 'high' ELSE 'unknown' END AS confidence,
  CASE WHEN ok THEN round(CASE WHEN k % 4 = 1 THEN 0 - lat ELSE lat END, 8) END AS lat FROM p""")
def extracted_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X26 in P8: positions in the verbatim coordinates spare the model."""
    rows = _angles(spark, sf_dir).select(F.col("k").alias(S.ROW), F.lit("By the river").alias("Locality verbatim"), F.col("text").alias("verbatimCoordinates"))
    out = coords.preprocess(rows)
    return out.select(F.col(S.ROW).alias("k"), F.col("pre_source").alias("source"), F.col("pre_confidence").alias("confidence"), F.round("pre_lat", 8).alias("lat"))


# --- elevations ------------------------------------------------------------------------------------------------------

_HIGH = "h AS (SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 9500 AS DOUBLE) AS a, CAST(s_suppkey * 37 % 9500 + s_suppkey % 400 AS DOUBLE) AS b FROM supplier)"


@query(f"""WITH {_HIGH}, m AS (SELECT k, CASE k % 5 WHEN 0 THEN a WHEN 1 THEN a * 0.3048 WHEN 2 THEN a WHEN 3 THEN a * 0.3048 END AS low,
  CASE k % 5 WHEN 0 THEN a WHEN 1 THEN b * 0.3048 WHEN 2 THEN b WHEN 3 THEN a * 0.3048 END AS high FROM h)
SELECT k, CASE WHEN high <= 9000 THEN round(low, 6) END AS low, CASE WHEN high <= 9000 THEN round(high, 6) END AS high, CASE WHEN high <= 9000 THEN round((low + high) / 2, 6) END AS meters FROM m""")
def written_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres, feet, ranges, named and bare ones; distances and depths are none."""
    k = F.col("s_suppkey")
    rows = _t(spark, sf_dir, "supplier").select(k.alias("k"), (k * 37 % 9500).alias("a"), (k * 37 % 9500 + k % 400).alias("b"), "s_name")
    forms = [
        F.concat(F.lit("5 km N of "), "s_name", F.lit(", elevation "), "a", F.lit("m, 20 m. W. of the road")),
        F.concat("s_name", F.lit(", "), "a", F.lit("-"), "b", F.lit("ft, in wood")),
        F.concat("s_name", F.lit(" (alt. "), "a", F.lit(" to "), "b", F.lit(" metres), 3 miles east")),
        F.concat("s_name", F.lit(", "), F.format_string("%,d", F.col("a").cast("long")), F.lit(" feet above sea level")),
        F.concat("s_name", F.lit(", depth "), "a", F.lit(" m, "), "b", F.lit(" m off shore")),
    ]
    text = forms[4]
    for i in range(4):
        text = F.when(F.col("k") % 5 == i, forms[i]).otherwise(text)
    found = rows.select("k", elevation.elevation(text).alias("e"))
    return found.select("k", F.round("e.low", 6).alias("low"), F.round("e.high", 6).alias("high"), F.round("e.meters", 6).alias("meters"))


# --- names -----------------------------------------------------------------------------------------------------------

_COUNTIES = ", ".join(f"({i + 1}, '{name}')" for i, name in enumerate(gazetteer.VICE_COUNTIES))


@query(f"""WITH c(n, name) AS (VALUES {_COUNTIES}), t AS (SELECT p_partkey, p_partkey % 125 AS n FROM part)
SELECT p_partkey, name AS region, CASE WHEN name IS NOT NULL THEN 'VC ' || t.n || CASE WHEN p_partkey % 3 = 0 THEN ' (county name inferred)' ELSE '' END END AS notes FROM t LEFT JOIN c USING (n)""")
def vice_county_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vice-county numbers, some without a county's name."""
    k = F.col("p_partkey")
    number = (k % 125).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("VC"), number)).when(k % 3 == 1, F.concat("p_name", F.lit(", v.c. "), number)).otherwise(F.concat(F.lit("Hants, VC "), number, F.lit(" (old)")))
    rows = _t(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return gazetteer.with_vice_county(rows, "text").select("p_partkey", "region", "notes")


_SHORT = [(a, b) for a, b in gazetteer.ABBREVIATIONS]


@query(f"""WITH d(i, p, e) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_SHORT))})
SELECT c_custkey, e || ' ' || c_name || ', ' || e || '; ' || lower(p) || ' x' || chr(10) || e AS text FROM customer JOIN d ON c_custkey % {len(_SHORT)} = i""")
def expanded_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations written out, the rest of a text as it is."""
    names = F.split(F.lit("|".join(a for a, _ in _SHORT)), r"\|")
    short = F.get(names, (F.col("c_custkey") % len(_SHORT)).cast("int"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(short, F.lit(" "), "c_name", F.lit(", "), short, F.lit("; "), F.lower(short), F.lit(" x\n"), short).alias("raw"))
    return gazetteer.expanded(rows, gazetteer.abbreviations(spark), "c_custkey", "raw", "text").select("c_custkey", "text")


_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-''’/][\p{L}\p{N}]+)*\.?')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT DISTINCT unnest([w[1:2], w[1:3]]) AS p FROM w WHERE len(w) >= 3),
d AS (SELECT DISTINCT [lower(regexp_replace(x, '\\.$', '')) FOR x IN p] AS key, [ends_with(x, '.') FOR x IN p] AS dots FROM p),
r AS (SELECT doc_id, i, n, [lower(regexp_replace(x, '\\.$', '')) FOR x IN w[i + 1:i + n]] AS key, [ends_with(x, '.') FOR x IN w[i + 1:i + n]] AS there
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM w, (VALUES (2), (3)) s(n))),
m AS (SELECT DISTINCT doc_id, CAST(i AS INTEGER) AS i, n FROM r JOIN d USING (key) WHERE list_bool_and([z[1] OR NOT z[2] FOR z IN list_zip(there, dots)])),
f AS (SELECT doc_id, list_reduce(list_prepend({{'i': -1, 'l': 0, 'e': 0, 'k': '', 'c': 0}}, list({{'i': i, 'l': -n, 'e': i + n, 'k': '', 'c': 0}} ORDER BY i, n DESC)),
  lambda a, x: CASE WHEN x.i >= a.e THEN {{'i': x.i, 'l': x.l, 'e': x.e, 'k': a.k || ',' || x.i || ':' || (-x.l), 'c': a.c + 1}} ELSE a END) AS f FROM m GROUP BY doc_id)
SELECT doc_id, f.c AS n, md5(f.k) AS places FROM f""")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that grows with the table (the first two and three words of every text) against all texts."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    # only as much of each text is cut into words as holds the first three
    head = F.regexp_extract("text", rf"\A(?:[^\p{{L}}\p{{N}}]*+(?>{gazetteer.WORD})){{3}}", 0)
    words = F.regexp_extract_all(head, F.lit(gazetteer.WORD), F.lit(0))
    phrases = docs.select(words.alias("w")).where(F.size("w") >= 3).select(F.explode(F.array(F.slice("w", 1, 2), F.slice("w", 1, 3))).alias("p")).select(F.array_join("p", " ").alias("phrase")).distinct()
    found = gazetteer.matches(docs, phrases, "doc_id", "text")
    places = F.array_join(F.transform("found", lambda m: F.concat(F.lit(","), m["start"].cast("string"), F.lit(":"), m["size"].cast("string"))), "")
    return found.select("doc_id", F.size("found").alias("n"), F.md5(places.cast("binary")).alias("places"))
