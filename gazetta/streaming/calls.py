"""The model-call stage: rate-limited, retried, and written to a ledger so that no call is made twice.

Calls cost money and are not repeatable, so their results are materialised: candidates without a ledger entry are
called in Arrow batches and appended; everything downstream reads the ledger.  Started again, a run calls only what
the ledger lacks.  Run it with speculation off.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.json_text import first_object, object_map, rescan_objects, response_fields, token_usage
from ..operators.coords import preprocess, prompt, prompt_context
from ..operators.prep import deduplicate, expand, filter_records
from ..operators.resolve import CTRY, LOC, prompt_locality
from ..operators.results import realtime_columns
from ..session import materialise

LEDGER = "request_id string, response string, error string, attempts int"
MAX_RETRIES = 5
#: Seconds before the first retry, by HTTP status; they double each time.  Other errors wait PAUSE seconds.
BACKOFF = {429: 3, 500: 4, 529: 5}
PAUSE = 2


class CallError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


class Provider(Protocol):
    """What a model must offer.  Instances travel to the tasks, so they must pickle."""

    name: str
    requests_per_minute: int

    def call(self, prompt: str) -> str:
        """The text of the answer, or CallError."""
        ...


class StubProvider:
    """Deterministic answers without a network: coordinates from a checksum of the prompt."""

    name, requests_per_minute = "stub", 0

    def call(self, prompt: str) -> str:
        n = zlib.crc32(prompt.encode())
        return json.dumps({"country": "X", "latitude": n % 180 - 90, "longitude": n // 180 % 360 - 180, "coordinate_source": "estimated", "confidence": ("low", "medium", "high")[n % 3], "notes": "stub"})


def call_with_retry(provider: Provider, text: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts)."""
    for attempt in range(MAX_RETRIES + 1):
        try:
            return provider.call(text), None, attempt + 1
        except CallError as e:
            if attempt == MAX_RETRIES or e.status not in BACKOFF:
                return None, str(e), attempt + 1
            sleep(BACKOFF[e.status] * 2**attempt)
        except Exception as e:
            if attempt == MAX_RETRIES:
                return None, str(e), attempt + 1
            sleep(PAUSE)
    raise AssertionError


def call_stage(requests: DataFrame, provider: Provider, concurrency: int = 8) -> DataFrame:
    """requests: request_id, prompt.  One ledger row each; ``concurrency`` tasks share the provider's rate."""
    gap = 60.0 * concurrency / provider.requests_per_minute if provider.requests_per_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            rows = []
            for request, text in zip(batch["request_id"], batch["prompt"], strict=True):
                if gap:
                    time.sleep(max(0.0, last + gap - time.monotonic()))
                    last = time.monotonic()
                rows.append((request, *call_with_retry(provider, text)))
            yield pd.DataFrame(rows, columns=["request_id", "response", "error", "attempts"])

    return requests.select("request_id", "prompt").repartition(concurrency, "request_id").mapInPandas(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def requests_of(candidates: DataFrame, instructions: str) -> DataFrame:
    """Candidates with pre_* columns, request_id (a hash of the place key, so unique) and prompt."""
    rows = preprocess(candidates)
    text = prompt(instructions, prompt_locality(candidates.columns), F.col(CTRY), prompt_context())
    return rows.withColumn("request_id", F.concat(F.lit("gz_"), F.substring(F.sha1(S.DEDUP_KEY), 1, 24))).withColumn("prompt", text)


def settle(requests: DataFrame, provider: Provider, ledger: str, concurrency: int = 8) -> DataFrame:
    """Call what the ledger lacks, append it, and return the ledger."""
    spark = requests.sparkSession
    todo = requests.join(read_ledger(spark, ledger).select("request_id"), "request_id", "left_anti")
    call_stage(todo, provider, concurrency).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def answered(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests with the produced columns of their answers."""
    joined = requests.join(ledger, "request_id", "left")
    found = F.coalesce(first_object(F.col("response")), F.when(F.instr("response", "{") > 0, rescan_objects(F.col("response"))))
    rows = joined.withColumn("__found", F.when(F.col("error").isNull(), found)).withColumn("__fields", object_map(F.col("__found"))).withColumn("__o", response_fields(F.col("__fields"))).drop("__found", "__fields")
    rows = rows.withColumn("called", F.col("error").isNull()).withColumn("success", F.col("__o").isNotNull()).withColumn("error", F.coalesce("error", F.when(F.col("__o").isNull(), F.lit("No valid JSON found in response"))))
    own = [c for c in requests.columns if c not in S.PRODUCED and not c.startswith("pre_")]
    produced = realtime_columns(F.col(LOC), F.col(CTRY))
    return rows.select(*own, *[v.alias(k) for k, v in produced.items()])


def process(df: DataFrame, provider: Provider, ledger: str, instructions: str = "", include_existing: bool = False, concurrency: int = 8) -> DataFrame:
    """Every input row with produced columns: one call per place that needs one, expanded back onto all rows."""
    candidates = deduplicate(filter_records(df, include_existing))
    requests = requests_of(candidates, instructions)
    done = answered(requests, settle(requests, provider, ledger, concurrency))
    return expand(df, done)


def run_statistics(ledger: DataFrame, cost_per_call: float) -> DataFrame:
    """One row: calls, processed, failed, cost."""
    return ledger.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("api_calls"), F.count("*").alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), (F.count("*") * cost_per_call).alias("cost"))


def usage(ledger: DataFrame) -> DataFrame:
    return ledger.select("request_id", token_usage(F.col("response")).alias("u")).select("request_id", "u.*")


def stream_process(spark: SparkSession, folder: str, schema: str, checkpoint: str, provider: Provider, ledger: str, instructions: str = "") -> int:
    """Process the files that a folder has gained since the last run; returns the number of ledger rows."""

    def one(batch: DataFrame, _: int) -> None:
        # its files are read, and counted, once: stages that run beside each other would both fill a cache
        settle(requests_of(deduplicate(filter_records(materialise(batch, "arrived"))), instructions), provider, ledger)

    source = spark.readStream.schema(schema).parquet(folder)
    query = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_ledger(spark, ledger).count()
