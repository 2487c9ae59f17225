"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes and confirmed by digest.

Each URL is expanded into the expressions ``host suffix + path prefix`` of the shapes that rules have (numbers of host
labels, path lengths).  Expressions and rules meet in an equi-join on the first eight hex digits of their SHA-256;
the full digest confirms a hit.  Of the rules that fit, the longest wins, then the one that comes last by name, then
``block`` over ``allow``.

Rules are broadcast only if their text is at most ``broadcast_bytes``; a larger rule table is joined by a shuffle in
which URLs are dealt over ``salts`` copies of the rules, as one short rule may fit a third of all URLs.

Defined cases: rule hosts are lower-cased, and a rule with a null host, path or verdict fits nothing; host and path are
hashed with a mark between them, so a rule path that does not start with ``/`` fits no URL of another host; a null URL or one without ``://`` has an empty host and path and gets the default verdict, as does a URL
that no rule fits; repeated rows are judged each; empty tables and empty rule sets work; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
SALTS = 32
SHORT = 8
#: Between host and path in what is hashed; no host holds it.
_MARK = "/"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col(text), 256)).withColumn("short", F.substring("digest", 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """rules: host, path, verdict.  One row per page: id, host, path, rule (null if none fits), verdict."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where(F.concat("host", "path", "verdict").isNotNull())
    rules = rules.select(F.concat("host", "path").alias("rule"), F.concat("host", F.lit(_MARK), "path").alias("key"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    shape = rules.agg(F.sum(F.octet_length("rule") + 80).alias("bytes"), F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    urls = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("uid", "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    label_counts = F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>")
    path_lengths = F.array(*[F.lit(n) for n in shape["chars"]]).cast("array<int>")

    fitting = F.filter(label_counts, lambda n: (F.col("host") != "") & (n <= F.size(F.split("host", r"\."))))
    prefixes = F.filter(path_lengths, lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(fitting, lambda n: F.transform(prefixes, lambda m: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -n), F.lit(_MARK), F.substring(F.col("path"), F.lit(1), m)))))
    expressions = _hashed(urls.withColumn("expression", F.explode_outer(pairs)), "expression")
    known = _hashed(rules, "key").select("short", F.col("digest").alias("rule_digest"), "rule", F.col("verdict").alias("rule_verdict"), F.length("rule").alias("size"))
    if (shape["bytes"] or 0) <= broadcast_bytes:
        met = expressions.join(F.broadcast(known), "short", "left")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")).join(dealt, ["short", "salt"], "left")
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.struct("size", "rule", "rule_verdict"))
    best = met.groupBy("uid", "id", "host", "path").agg(F.max(hit).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
