"""Asynchronous provider batches: prepare, submit, poll, fetch, cancel; staggered submission."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import combine, provider_stagger, sub_batches
from ..operators.results import chat_results, keyed_results, merge_with_source, message_results
from ..session import new_path
from ..sources.writers import chat_request, keyed_request, write_file
from .calls import Provider, call_stage

#: Seconds between polls, and after how many to give up.
POLL_S, LIMIT_S = 60, 25 * 3600
READERS = {"openai": chat_results, "anthropic": message_results, "google": keyed_results, "gemini": keyed_results, "claude": message_results}


class BatchProvider(Protocol):
    provider: str

    def submit(self, requests: str) -> str: ...
    def status(self, batch_id: str) -> dict: ...
    def results(self, batch_id: str) -> DataFrame: ...
    def cancel(self, batch_id: str) -> bool: ...


def reader_for(provider: str) -> Callable[[DataFrame], DataFrame] | None:
    """The result reader of a provider, by substring of its name."""
    return next((f for k, f in READERS.items() if k in provider.lower()), None)


def request_lines(requests: DataFrame, provider: str, model: str, max_tokens: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """One text column: request lines with safe ids in the provider's layout, and the columns ``keep``."""
    make = keyed_request(F.col("request_id"), F.col("prompt"), F.lit(max_tokens)) if "goog" in provider.lower() or "gemini" in provider.lower() else chat_request(F.col("request_id"), F.lit(model), F.col("prompt"), F.lit(max_tokens))
    return requests.select(make.alias("value"), *(keep or []))


class FolderProvider:
    """A provider kept in a folder (for tests and dry runs).  Submitted requests wait there; as soon as somebody asks for a
    state or for results, a :class:`Provider` answers all that wait, together, so the number of Spark jobs does not follow
    the number of batches."""

    def __init__(self, spark: SparkSession, folder: str, model: Provider, provider: str = "openai"):
        self.spark, self.folder, self.model, self.provider = spark, folder, model, provider
        self._cancelled: set[str] = set()
        self._waiting: dict[str, str] = {}  # batch: folder of its requests
        self._answers: dict[str, tuple[str, int]] = {}  # batch: table of its answers, how many

    def submit(self, requests: str) -> str:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(requests)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(requests)
        batch_id = f"batch_{hashlib.sha1(requests.encode()).hexdigest()[:16]}"
        self._waiting[batch_id] = requests
        return batch_id

    def _answer(self) -> None:
        """Answer what waits: one table, with the batch of every answer."""
        todo = {b: r for b, r in self._waiting.items() if b not in self._cancelled}
        if not todo:
            return
        lines = self.spark.read.text(list(todo.values()))
        batch_of = {r.rstrip("/").rsplit("/", 1)[1]: b for b, r in todo.items()}
        if len(batch_of) < len(todo):  # folders of one name: batch by batch
            lines = combine([self.spark.read.text(r).withColumn("batch", F.lit(b)) for b, r in todo.items()])
        else:
            names = self.spark.createDataFrame(list(batch_of.items()), "name string, batch string")
            name = F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
            lines = lines.select("value", name.alias("name")).join(F.broadcast(names), "name")
        v = F.col("value")
        keyed = reader_for(self.provider) is keyed_results
        key, text = ("$.key", "$.request.contents[0].parts[0].text") if keyed else ("$.custom_id", "$.body.messages[0].content")
        asked = lines.select(F.to_json(F.struct("batch", F.get_json_object(v, key).alias("id"))).alias("request_id"), F.get_json_object(v, text).alias("prompt"))
        answers = call_stage(asked, self.model)
        answers = answers.withColumn("batch", F.get_json_object("request_id", "$.batch")).withColumn("request_id", F.get_json_object("request_id", "$.id"))
        if keyed:
            out = F.struct(F.col("request_id").alias("key"), F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("response").alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response"))
        else:
            body = F.struct(F.array(F.struct(F.struct(F.col("response").alias("content")).alias("message"))).alias("choices"))
            out = F.struct(F.col("request_id").alias("custom_id"), F.struct(F.when(F.col("error").isNull(), 200).otherwise(500).alias("status_code"), body.alias("body")).alias("response"))
        path = f"{self.folder}/answers-{uuid.uuid4().hex}"
        answers.select(F.to_json(out).alias("value"), "batch").write.parquet(path)
        counts = {r.batch: r.n for r in self.spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n")).collect()}  # one row a batch
        for b in todo:
            self._answers[b] = path, counts.get(b, 0)
            del self._waiting[b]

    def status(self, batch_id: str) -> dict:
        if batch_id in self._cancelled:
            return {"status": "cancelled", "total": 0, "succeeded": 0, "failed": 0}
        if batch_id in self._waiting:
            self._answer()
        n = self._answers[batch_id][1]
        return {"status": "completed", "total": n, "succeeded": n, "failed": 0}

    def results(self, batch_id: str) -> DataFrame:
        return self.results_of([batch_id])

    def results_of(self, batch_ids: list[str]) -> DataFrame:
        """All in one scan."""
        reader = reader_for(self.provider)
        if reader is None:
            raise ValueError(f"no reader for {self.provider}")
        if any(b in self._waiting for b in batch_ids):
            self._answer()
        paths = sorted({self._answers[b][0] for b in batch_ids if b in self._answers})
        if not paths:
            return reader(self.spark.createDataFrame([], "value string"))
        wanted = self.spark.createDataFrame([(b,) for b in dict.fromkeys(batch_ids)], "batch string")
        return reader(self.spark.read.parquet(*paths).join(F.broadcast(wanted), "batch").select("value"))

    def cancel(self, batch_id: str) -> bool:
        self._cancelled.add(batch_id)
        return True


class HostedBatches:
    """Batches of a hosted chat-style provider: request files are uploaded, a job is made of each, its output is fetched.

    A sub-batch holds at most a few thousand requests (see STAGGER), so one file passes through the driver at a time; the
    access key is read from a named environment variable.  Fetched output is kept in the shared folder."""

    provider = "openai"

    def __init__(self, spark: SparkSession, base: str, key_variable: str, timeout: float = 120):
        self.spark, self.base, self.key_variable, self.timeout = spark, base.rstrip("/"), key_variable, timeout

    def _ask(self, method: str, path: str, body: bytes | None = None, kind: str = "application/json") -> bytes:
        headers = {"Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"} | ({"Content-Type": kind} if body is not None else {})
        with urllib.request.urlopen(urllib.request.Request(f"{self.base}{path}", body, headers, method=method), timeout=self.timeout) as answer:
            return answer.read()

    def submit(self, requests: str) -> str:
        lines = "\n".join(r.value for r in self.spark.read.text(requests).toLocalIterator())
        mark = uuid.uuid4().hex
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch', f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="requests.jsonl"\r\n\r\n{lines}\n', f"--{mark}--\r\n"]
        file = json.loads(self._ask("POST", "/files", "\r\n".join(parts).encode(), f"multipart/form-data; boundary={mark}"))
        job = {"input_file_id": file["id"], "endpoint": "/v1/chat/completions", "completion_window": "24h"}
        return json.loads(self._ask("POST", "/batches", json.dumps(job).encode()))["id"]

    def status(self, batch_id: str) -> dict:
        job = json.loads(self._ask("GET", f"/batches/{batch_id}"))
        counts = job.get("request_counts") or {}
        return {"status": job["status"], "total": counts.get("total", 0), "succeeded": counts.get("completed", 0), "failed": counts.get("failed", 0), "files": [job[k] for k in ("output_file_id", "error_file_id") if job.get(k)]}

    def results(self, batch_id: str) -> DataFrame:
        return self.results_of([batch_id])

    def results_of(self, batch_ids: list[str]) -> DataFrame:
        """All in one scan; lines of the output and of the error files."""
        files = [f for b in batch_ids for f in self.status(b)["files"]]
        folder = new_path(self.spark, "batch-results")
        paths = [write_file(self.spark, f"{folder}/{f}.jsonl", self._ask("GET", f"/files/{f}/content")) for f in files]
        return chat_results(self.spark.read.text(paths) if paths else self.spark.createDataFrame([], "value string"))

    def cancel(self, batch_id: str) -> bool:
        return json.loads(self._ask("POST", f"/batches/{batch_id}/cancel", b"{}"))["status"] in ("cancelling", "cancelled")


def wait(provider: BatchProvider, batch_id: str, sleep: Callable[[float], None] = time.sleep, poll: float = POLL_S, limit: float = LIMIT_S) -> dict:
    """Poll until the job has ended in any way, or the limit is reached."""
    waited = 0.0
    while True:
        state = provider.status(batch_id)
        if state["status"] in ("completed", "ended", "failed", "cancelled", "expired", "succeeded") or waited >= limit:
            return state
        sleep(poll)
        waited += poll


def submit_staggered(requests: DataFrame, order: list[str], provider: BatchProvider, model: str, folder: str, size: int | None = None, delay: float | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Submit in sub-batches with pauses; the first error ends it.  Returns the summary (see SUMMARY in operators.jobs)."""
    own_size, own_delay = provider_stagger(provider.provider)
    size, delay = size or own_size, own_delay if delay is None else delay
    numbered = sub_batches(requests, order, size).persist()
    try:
        plan = numbered.groupBy("batch_number", "start_record", "end_record").agg(F.count("*").alias("n")).orderBy("batch_number").collect()
        request_lines(numbered, provider.provider, model, keep=["batch_number"]).write.mode("overwrite").partitionBy("batch_number").text(f"{folder}/requests")
        summary: dict = {"total_records": sum(b.n for b in plan), "batch_size": size, "provider": provider.provider, "model": model, "batches": []}
        for b in plan:
            try:
                batch_id = provider.submit(f"{folder}/requests/batch_number={b.batch_number}")
            except Exception as e:
                summary["error"] = str(e)
                break
            summary["batches"].append({"batch_number": b.batch_number, "total_batches": len(plan), "batch_id": batch_id, "start_record": b.start_record, "end_record": b.end_record, "record_count": b.n})
            if b is not plan[-1]:
                sleep(delay)
    finally:
        numbered.unpersist()
    summary["batches_submitted"] = len(summary["batches"])
    return summary


def save_summary(summary: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(summary, f, ensure_ascii=False, indent=2)


def fetch(provider: BatchProvider, batch_ids: list[str], source: DataFrame, id_col: str = "Barcode") -> DataFrame:
    """Mapped records of all sub-batches, with their source columns."""
    together = getattr(provider, "results_of", None)
    out = together(batch_ids) if together else combine([provider.results(b) for b in batch_ids])
    return merge_with_source(out, source, id_col)
