"""Batch jobs: sub-batches, their records, status and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Provider -> (records in a sub-batch, seconds between submissions).
STAGGER = {"google": (500, 120), "anthropic": (1000, 30), "openai": (2000, 10)}
BATCH = "batch_number int, total_batches int, batch_id string, batch_name string, provider string, model string, dataset string, start_record long, end_record long, record_count long, submitted_at string, output_formats array<string>, use_dwc boolean, deduplicated boolean"
INFO = "batch_id string, batch_name string, provider string, model string, dataset string, record_count long, submitted_at string, output_formats array<string>, use_dwc boolean, deduplicated boolean, batch_number int"
SUMMARY = f"total_records long, batch_size long, batches_submitted long, provider string, model string, dataset string, submitted_at string, output_formats array<string>, use_dwc boolean, deduplicated boolean, batches array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BATCH.split(', '))}>>"
JOB_COLUMNS = ("batch_id", "batch_name", "provider", "model", "dataset", "record_count", "submitted_at", "output_formats", "use_dwc", "deduplicated")


def ordinals(df: DataFrame, order: list[str], name: str = "__n") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order without a single-partition window.

    Rows are range-partitioned and sorted; each partition's size shifts the numbers of those after it.  They are written
    once, as ranges come from samples that a second reading would draw anew."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__in") - 1).cast("long")).drop("__part", "__in", "__start")


def sub_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds batch_number (from 1), start_record and end_record (from 1) of the sub-batch that holds the row."""
    rows = ordinals(df, order)
    number = F.floor(F.col("__n") / size)
    total = df.count()
    return rows.select(*df.columns, (number + 1).cast("int").alias("batch_number"), (number * size + 1).cast("long").alias("start_record"), F.least((number + 1) * size, F.lit(total)).cast("long").alias("end_record"))


def provider_stagger(provider: str) -> tuple[int, int]:
    return next((v for k, v in STAGGER.items() if k in provider.lower()), STAGGER["anthropic"])


def status(state: Column) -> Column:
    """A provider's state name to one of ours."""
    up = F.upper(F.coalesce(state, F.lit("")))
    out = F.lit("unknown")
    for mark, name in reversed((("SUCCEEDED", "completed"), ("FAILED", "failed"), ("CANCEL", "cancelled"), ("EXPIRED", "expired"), ("RUNNING", "running"), ("PENDING", "pending"))):
        out = F.when(up.contains(mark), F.lit(name)).otherwise(out)
    return out


def is_complete(state: Column, succeeded: Column, total: Column) -> Column:
    return F.coalesce((succeeded == total) & (total > 0), F.lit(False)) | F.lower(state).isin("completed", "ended")


def ended(state: Column) -> Column:
    return F.lower(state).rlike("ended|succeeded|completed")


def roll_up(batches: DataFrame, state: str = "status", succeeded: str = "succeeded", failed: str = "failed", records: str = "record_count") -> DataFrame:
    """One row: completed, pending and failed batches, records in all, succeeded and failed ones of completed batches."""
    low = F.lower(F.col(state))
    done, bad = low.isin("completed", "succeeded", "success"), low.isin("failed", "error")
    return batches.agg(
        F.count_if(done).alias("completed"),
        F.count_if(~done & ~bad).alias("pending"),
        F.count_if(bad).alias("failed"),
        F.coalesce(F.sum(records), F.lit(0)).cast("long").alias("total_records"),
        F.coalesce(F.sum(F.when(done, F.col(succeeded))), F.lit(0)).cast("long").alias("total_succeeded"),
        F.coalesce(F.sum(F.when(done, F.col(failed))), F.lit(0)).cast("long").alias("total_failed"),
    )


def state_total(*states: Column) -> Column:
    out = F.lit(0).cast("long")
    for s in states:
        out = out + F.coalesce(s, F.lit(0))
    return out


def latest(jobs: DataFrame, k: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("submitted_at"), "batch_id").limit(k)


def read_infos(spark: SparkSession, folder: str) -> DataFrame:
    """Single-job files; unreadable ones are skipped."""
    return spark.read.schema(INFO).json(folder, multiLine=True, pathGlobFilter="*_info.json", mode="DROPMALFORMED").orderBy(F.desc("submitted_at"))


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(folder, multiLine=True, pathGlobFilter="*_staggered_summary.json", mode="DROPMALFORMED")


def summary_batches(summaries: DataFrame) -> DataFrame:
    return summaries.select(F.inline("batches"))


def list_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Staggered jobs and single ones (not those that are part of a staggered job), newest first."""
    single = read_infos(spark, folder).where("batch_number is null and batch_id is not null").select(*JOB_COLUMNS, F.lit("single").alias("kind"))
    many = read_summaries(spark, folder).select(F.lit(None).cast("string").alias("batch_id"), F.col("dataset").alias("batch_name"), "provider", "model", "dataset", F.col("total_records").alias("record_count"), "submitted_at", "output_formats", "use_dwc", "deduplicated", F.lit("staggered").alias("kind"))
    return single.unionByName(many).orderBy(F.desc("submitted_at"))


def combine(parts: list[DataFrame]) -> DataFrame:
    """Sub-batch results as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
