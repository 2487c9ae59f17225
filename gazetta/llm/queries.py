"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, langid, line_dedup, merkle, near_dedup, oracles, packing, secret_scan, substring_dedup, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    filters = langid.fit(docs, where=~held_out)
    return langid.predict(docs.withColumn("held_out", held_out), filters, keep=["doc_id", "held_out"]).drop("evidence")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "stays")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_sentences", "n_removed")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.fresh_ledger(spark), ["doc_id"])
    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("findings")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "lines_removed", "chunks_removed")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(rows)
    out = vector_codes.label_errors(vector_codes.encode(rows, books))
    return out.drop("label").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = bpe.decode(encoded.withColumn("ids_sha256", F.sha2("ids", 256)), keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(docs, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=even)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": oracles.URL_FILTER,
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op4_benchmark_decontamination": oracles.DECONTAMINATION,
    "op8_secret_scan": oracles.SECRET_SCAN,
    "op11_vector_codes": oracles.VECTOR_CODES,
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
