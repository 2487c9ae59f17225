"""Corpus pipeline: documents -> language ID -> line dedup -> near-dedup -> decontamination -> packed sequences.

Each stage reads what its predecessor wrote, takes (spark, docs, sf_dir) and, but for the last, returns the columns of
its input (the text and n_chars changed where lines went).  Empty inputs, nulls, repeated rows and further columns,
also such as share names with the operators' results, are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm import decontaminate, langid, line_dedup, near_dedup, packing
from gazetta.llm.common import materialise, numbered, possible, shuffled, small_batches

#: A document of whose n-grams less than this part belongs to its best language is in none of the languages known.
LEAST_EVIDENCE = 0.35


def _masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """Columns under neutral names, the new name of each, and how to get the old names back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(new).alias(old) for old, new in names.items()]


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those whose uid is in gone (read from a table).  Rows that surely stay are not sent anywhere."""
    halves = possible(rows, F.col("uid"), gone, F.col("uid"))
    return halves.where("not __possible").unionByName(halves.where("__possible").join(shuffled(gone), "uid", "left_anti"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages go."""
    small_batches(spark)
    masked, names, back = _masked(docs)
    held_out = F.coalesce(F.crc32(F.col(names["doc_id"]).cast("string")) % 4 == 2, F.lit(False))
    filters = langid.fit(masked, names["doc_id"], names["text"], names["lang"], where=~held_out)
    found = langid.predict(masked, filters, names["text"])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("evidence") >= LEAST_EVIDENCE)).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing but white space is left for that."""
    masked, names, back = _masked(docs)
    out = line_dedup.line_dedup(masked, names["doc_id"], names["text"])
    text, cut = F.col(names["text"]), F.col("lines_removed") > 0
    if "n_chars" in names:
        size = F.col(names["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(size))
    return out.where(~cut | text.rlike(r"\S")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    small_batches(spark)
    masked, names, back = _masked(docs)
    rows = numbered(masked, "uid")
    found = near_dedup.near_duplicates(rows, names["doc_id"], names["text"], uid_col="uid")
    return _without(rows, materialise(found.where(~F.col("stays")).select("uid"), "goes")).select(*back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    masked, names, back = _masked(docs)
    rows = numbered(masked, "uid")
    hits = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "uid", names["text"])
    return (masked if hits is None else _without(rows, hits)).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and place."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: No SQL engine can express the signatures, filters and token ids; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
