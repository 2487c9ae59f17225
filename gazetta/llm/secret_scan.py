"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes (its blob).  The ledger keeps, for each pair of blob
and rule version, what was found.  A scan reads only blobs whose pair with some current rule version is missing,
appends its findings, and joins them back to every row (path, version) that holds the blob.  Findings name their rule
version, so a changed rule replaces its former findings; they are listed by start, then in the order of the rules.  Only
built-in functions run on the executors.

Spans are code-point places.  For each rule the text is split at its matches, so a match starts where the lengths of
the pieces and matches before it add up to (a running sum over the matches of one blob); matches that are too short
are then dropped, which is leftmost non-overlapping matching.

Defined cases: null text is empty text and its blob that of no bytes; repeated rows share a blob and each get its
findings; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, shuffled


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  # Java syntax
    hint: str  # cheap pattern that any text with a kept match holds
    value: str = ""  # pattern whose group 1 must be long enough; empty: the whole match
    least: int = 0
    base: bool = True

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Kinds, patterns and least lengths of the base rules, then what this method adds.
#: A run that is long enough is the leftmost match of its open-ended form, so access and hex state their length inline.
RULES = (
    Rule("assign", 1, _ASSIGN + "[A-Za-z0-9+/_.=-]+", _ASSIGN + "[A-Za-z0-9+/_.=-]", f"^{_ASSIGN}([A-Za-z0-9+/_.=-]+)$", 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", "[0-9a-f]{16}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----", base=False),
)
_LEDGER = "blob string, scanned array<string>, findings array<struct<start:int,rule:string,kind:string,stop:int,base:boolean>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per blob: rule versions it was scanned with, findings."""
    rows = spark.read.schema(_LEDGER).parquet(ledger)
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"), F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def _scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """todo: blob, text, missing (rule names), dealt by blob.  Ledger rows; every blob gets one."""
    text = F.col("text")
    per_rule = [
        F.when(
            F.array_contains("missing", r.name) & text.rlike(r.hint),
            F.struct(F.lit(rank).alias("rank"), F.transform(F.split(text, r.pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("found")),
        )
        for rank, r in enumerate(rules)
    ]
    by_rule = todo.select("blob", "missing", F.explode_outer(F.array_compact(F.array(*per_rule))).alias("r"))
    pairs = F.arrays_zip(F.slice("r.gaps", 1, F.size("r.found")).alias("gap"), F.col("r.found").alias("m"))
    each = by_rule.select("blob", "missing", F.col("r.rank").alias("rank"), F.posexplode_outer(pairs).alias("pos", "x"))
    upto = Window.partitionBy("blob", "rank").orderBy("pos")
    each = each.withColumn("stop", F.sum(F.col("x.gap") + F.length("x.m")).over(upto).cast("int"))
    name, kind, base, keep = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(False)
    for rank, r in enumerate(rules):
        mine = F.col("rank") == rank
        name, kind, base = (F.when(mine, F.lit(x)).otherwise(y) for x, y in ((r.name, name), (r.kind, kind), (r.base, base)))
        value = F.regexp_extract("x.m", r.value, 1) if r.value else F.col("x.m")
        keep = F.when(mine, F.length(value) >= r.least).otherwise(keep)
    finding = F.when(keep, F.struct((F.col("stop") - F.length("x.m")).alias("start"), name.alias("rule"), kind.alias("kind"), "stop", base.alias("base")))
    return each.groupBy("blob").agg(F.first("missing").alias("scanned"), F.collect_list(finding).alias("findings"))


def scan(versions: DataFrame, ledger: str, ids: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it there, and return the ``ids`` of every row with its blob and findings."""
    spark = versions.sparkSession
    rows = versions.select(*[F.col(c).alias(f"__{c}") for c in ids], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", blob_of(F.col("text")))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    blobs = rows.select("blob", "text").dropDuplicates(["blob"])  # copies meet in the map tasks before any is sent
    known = _exists(spark, ledger)
    if known:
        lacking = F.array_except(wanted, F.coalesce("scanned", F.array().cast("array<string>")))
        todo = blobs.join(read_ledger(spark, ledger).select("blob", "scanned"), "blob", "left").select("blob", "text", lacking.alias("missing")).where(F.size("missing") > 0)
    else:
        todo = blobs.withColumn("missing", wanted)
    _scan(todo, rules).write.mode("append").parquet(ledger)
    found = materialise(read_ledger(spark, ledger), "findings") if known else spark.read.schema(_LEDGER).parquet(ledger)
    ranked = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.array_position(wanted, f["rule"]).alias("rank"), f["kind"].alias("kind"), f["stop"].alias("stop"), f["base"].alias("base")))
    found = found.select("blob", F.sort_array(F.filter(ranked, lambda f: f["rank"] > 0)).alias("findings"))
    out = rows.drop("text").join(shuffled(found), "blob")
    return out.select(*[F.col(f"__{c}").alias(c) for c in ids], "blob", "findings")


def fresh_ledger(spark: SparkSession) -> str:
    return new_path(spark, "ledger")


def written(findings: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")
