"""Driver-side files of a run: resume state, job information, progress."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def state_path(folder: str, input_file: str) -> str:
    return os.path.join(folder, f".{os.path.basename(input_file)}.resume.json")


def save_state(folder: str, input_file: str, ledger: DataFrame, total: int, model: str, cost: float, started: str | None = None) -> dict:
    """What a run has done so far.  The ledger is the truth; this file only says where a user stands."""
    done = ledger.agg(F.count("*").alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("calls")).first()
    state = {
        "input_file": input_file,
        "input_file_size": os.path.getsize(input_file),
        "total_records": total,
        "last_completed_index": done.n - 1,
        "model_name": model,
        "start_time": started or datetime.now(timezone.utc).isoformat(),
        "api_calls": done.calls,
        "total_cost": done.n * cost,
    }
    with open(state_path(folder, input_file), "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False, indent=2)
    return state


def load_state(folder: str, input_file: str) -> dict | None:
    """The state of an unfinished run on the same file, with ``completed``; none if the file has another size by now."""
    try:
        with open(state_path(folder, input_file), encoding="utf-8") as f:
            state = json.load(f)
    except (OSError, ValueError):
        return None
    if state.get("input_file_size") != os.path.getsize(input_file):
        return None
    return state | {"completed": state["last_completed_index"] + 1}


def clear_state(folder: str, input_file: str) -> bool:
    try:
        os.remove(state_path(folder, input_file))
    except FileNotFoundError:
        return False
    return True


def save_job(folder: str, info: dict, staggered: bool = False) -> str:
    """Job information under the name that the job reader looks for; never half written."""
    name = f"{info.get('batch_name') or info.get('dataset') or 'job'}_{'staggered_summary' if staggered else 'info'}.json"
    path = os.path.join(folder, name)
    info = {"submitted_at": datetime.now(timezone.utc).isoformat()} | info
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(info, f, ensure_ascii=False, indent=2)
    os.replace(path + ".part", path)
    return path


class Progress(StreamingQueryListener):
    """Reports {'processed', 'batch'} after each micro-batch; an error in the callback does not end the stream."""

    def __init__(self, callback: Callable[[dict], None]):
        self.callback, self.processed = callback, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.processed += event.progress.numInputRows
        try:
            self.callback({"processed": self.processed, "batch": event.progress.batchId})
        except Exception as e:
            print(f"progress callback: {e}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Cached:
    """A value that is fetched again after ``ttl`` seconds; failures are kept as the fallback for as long."""

    def __init__(self, fetch: Callable[[], object], fallback: object, ttl: float = 15.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.fallback, self.ttl, self.clock = fetch, fallback, ttl, clock
        self._at: float | None = None
        self._value: object = fallback

    def get(self) -> object:
        if self._at is None or self.clock() - self._at >= self.ttl:
            try:
                self._value = self.fetch()
            except Exception:
                self._value = self.fallback
            self._at = self.clock()
        return self._value

    def clear(self) -> None:
        self._at = None
