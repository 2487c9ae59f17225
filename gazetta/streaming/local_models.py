"""Models served on this machine: which are installed, and a provider that asks one."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from .calls import CallError
from .state import Cached

ENDPOINT = "http://localhost:11434"
PROBE_S, CALL_S = 0.5, 120


def installed(endpoint: str = ENDPOINT) -> list[str]:
    """Model tags the local server offers; an error if it does not answer."""
    with urllib.request.urlopen(f"{endpoint}/api/tags", timeout=PROBE_S) as answer:
        return [m["name"] for m in json.load(answer).get("models", [])]


def installed_cached(endpoint: str = ENDPOINT) -> Cached:
    return Cached(lambda: installed(endpoint), [])


def installed_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "model_id string")


class LocalModel:
    """A provider for one local model."""

    requests_per_minute = 0

    def __init__(self, name: str, endpoint: str = ENDPOINT):
        self.name, self.endpoint = name, endpoint

    def call(self, prompt: str) -> str:
        body = json.dumps({"model": self.name, "stream": False, "format": "json", "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(f"{self.endpoint}/api/chat", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=CALL_S) as answer:
                return json.load(answer)["message"]["content"]
        except urllib.error.HTTPError as e:
            raise CallError(e.code, str(e)) from e
