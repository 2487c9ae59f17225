"""Cost and time estimates over a table of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS_IN, TOKENS_OUT = 200, 100
CACHED_SHARE, BATCH_SHARE = 0.90, 0.50
DEFAULT_RPM = 50

#: Name, USD per 1000 input tokens, USD per 1000 output tokens, USD per record, requests per minute.
MODELS = [
    ("claude_haiku_4_5", 0.001, 0.005, 0.0001, 50),
    ("claude_opus_4_8", 0.005, 0.025, 0.0006, 50),
    ("claude_sonnet_4_6", 0.003, 0.015, 0.0004, 50),
    ("gemini_3_1_pro", 0.002, 0.012, 0.0008, 360),
    ("gemini_3_5_flash", 0.0015, 0.009, 0.0003, 1000),
    ("gpt_4_1", 0.002, 0.008, 0.0008, 10000),
    ("gpt_4_1_mini", 0.0004, 0.0016, 0.00008, 10000),
    ("gpt_5", 0.00125, 0.01, 0.0006, 10000),
    ("gpt_5_mini", 0.00025, 0.002, 0.0001, 10000),
    ("openrouter_claude_haiku_4_5", 0.001, 0.005, 0.0002, 200),
    ("openrouter_claude_opus_4_8", 0.005, 0.025, 0.0008, 200),
    ("openrouter_claude_sonnet_4_6", 0.003, 0.015, 0.0004, 200),
    ("openrouter_gemini_3_5_flash", 0.0015, 0.009, 0.0003, 200),
    ("openrouter_gpt_4_1", 0.002, 0.008, 0.0008, 200),
    ("openrouter_gpt_5_mini", 0.00025, 0.002, 0.0002, 200),
    ("qwen3_14b_local", 0.0, 0.0, 0.0, 999999),
    ("qwen3_1_7b_local", 0.0, 0.0, 0.0, 999999),
    ("qwen3_8b_local", 0.0, 0.0, 0.0, 999999),
]


def models(spark: SparkSession) -> DataFrame:
    """The model catalogue: name, provider, prices per thousand and per million tokens, cost per record, rate."""
    table = spark.createDataFrame(MODELS, "name string, cost_per_1k_input double, cost_per_1k_output double, cost_per_record double, requests_per_minute long")
    return table.withColumns({"vendor": vendor(F.col("name")), "is_local": is_local(F.col("name")), "input_cost_per_million": F.col("cost_per_1k_input") * 1000, "output_cost_per_million": F.col("cost_per_1k_output") * 1000})


def vendor(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("openrouter"), "OpenRouter")
        .when(low.contains("claude"), "Anthropic")
        .when(low.contains("gpt") | low.contains("o1") | low.contains("o4"), "OpenAI")
        .when(low.contains("gemini"), "Google")
        .when(low.contains("qwen"), "Local (Ollama)")
        .otherwise("Unknown")
    )


def is_local(name: Column, provider: Column | None = None, kind: Column | None = None, endpoint: Column | None = None) -> Column:
    out = F.lower(name).contains("qwen")
    for test in (None if kind is None else kind == "local", None if provider is None else F.lower(provider).contains("ollama"), None if endpoint is None else F.lower(endpoint).contains("localhost:11434")):
        out = out if test is None else out | F.coalesce(test, F.lit(False))
    return out


def minutes(records: Column, rpm: Column) -> Column:
    return F.round(records / F.when(F.coalesce(rpm, F.lit(0)) == 0, F.lit(DEFAULT_RPM)).otherwise(rpm), 1)


def estimate(df: DataFrame, records: Column, per_million_in: Column, per_million_out: Column, batch: Column | bool = False, cached: Column | bool = True) -> DataFrame:
    """Adds base_cost, cache_savings, batch_discount, estimated_cost, cost_per_record, total_savings, savings_percentage.

    Batch and staggered modes both get the discount: pass whether one of them applies."""
    batch, cached = (x if isinstance(x, Column) else F.lit(x) for x in (batch, cached))
    put = records * TOKENS_IN / F.lit(1_000_000.0) * per_million_in
    got = records * TOKENS_OUT / F.lit(1_000_000.0) * per_million_out
    df = df.withColumns({"__in": put, "__out": got, "__records": records})
    df = df.withColumn("cache_savings", F.when(cached, F.col("__in") * CACHED_SHARE).otherwise(F.lit(0.0)))
    df = df.withColumn("__paid", F.col("__in") - F.col("cache_savings") + F.col("__out"))
    df = df.withColumn("batch_discount", F.when(batch, F.col("__paid") * BATCH_SHARE).otherwise(F.lit(0.0)))
    df = df.withColumns({"base_cost": F.col("__in") + F.col("__out"), "estimated_cost": F.col("__paid") - F.col("batch_discount"), "total_savings": F.col("cache_savings") + F.col("batch_discount")})
    df = df.withColumn("cost_per_record", F.when(F.col("__records") > 0, F.col("estimated_cost") / F.col("__records")).otherwise(F.lit(0.0)))
    df = df.withColumn("savings_percentage", F.when(F.col("base_cost") > 0, F.col("total_savings") / F.col("base_cost") * 100).otherwise(F.lit(0.0)))
    return df.drop("__in", "__out", "__records", "__paid")


def compare_models(table: DataFrame, records: int, batch: bool = False, by: str = "cost") -> DataFrame:
    """Each model's estimate, ranked by cost, time or name; caching applies to models with "cached" in their name."""
    out = estimate(table, F.lit(records), F.col("input_cost_per_million"), F.col("output_cost_per_million"), batch, F.lower("name").contains("cached"))
    out = out.withColumn("estimated_minutes", minutes(F.lit(records), F.col("requests_per_minute")))
    order = {"cost": ["estimated_cost", "name"], "time": ["estimated_minutes", "name"], "name": ["name"]}[by]
    return out.orderBy(*order)


def cheapest_and_fastest(compared: DataFrame) -> DataFrame:
    return compared.agg(F.min_by("name", F.struct("estimated_cost", "name")).alias("cheapest"), F.min_by("name", F.struct("estimated_minutes", "name")).alias("fastest"))


def batch_cost(df: DataFrame, records: Column, size: Column, per_1k_in: Column, per_1k_out: Column, rpm: Column) -> DataFrame:
    """Adds num_batches, input_cost, output_cost, total_cost, estimated_time_minutes, cost_per_record for fixed-size batches."""
    n = F.ceil(records / size)
    df = df.withColumns({"num_batches": n.cast("long"), "input_cost": n * (1600 + size * 100) / 1000.0 * per_1k_in, "output_cost": n * size * 130 / 1000.0 * per_1k_out})
    df = df.withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
    return df.withColumns({"estimated_time_minutes": F.col("num_batches") * (60 / rpm), "cost_per_record": F.when(records > 0, F.col("total_cost") / records).otherwise(F.lit(0.0))})


def with_catalogue(comparison: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Comparison rows with their catalogue entry.  The catalogue is a fixed small table."""
    return comparison.join(F.broadcast(catalogue), "name", "left")


def installed_only(table: DataFrame, installed: DataFrame) -> DataFrame:
    """Models whose id is installed."""
    return table.join(installed.select("model_id").distinct(), "model_id", "left_semi")


def not_in_catalogue(dynamic: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Dynamic models that the catalogue lacks."""
    return dynamic.join(catalogue.select("model_id").distinct(), "model_id", "left_anti")


def ready(local: Column, installed: Column, key: Column) -> Column:
    """Local models must be installed, others need an access key of more than ten characters."""
    return F.when(local, F.coalesce(installed, F.lit(False))).otherwise(F.coalesce(F.length(key) > 10, F.lit(False)))
