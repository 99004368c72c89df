"""A client of an answer service: equal requests once, a bounded number of calls at a time, deadlines, a memo and a log.

Requests are keyed by a hash of their payload. Those that the memo can answer are joined with
it; of the others each distinct one is called once, several at a time in a task, and a call that
passes its deadline becomes a row with ok = false, as one that fails does. The calls of a run are
one part of a table in the service's folder: it is read only once it is whole, so a lost executor
or driver adds no call twice. The parts are the log; those of their rows that are ok are the memo.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import storage

CALLS = "key string, payload string, ok boolean, response string, error string, tries int, seconds double, called_at timestamp"
_WAIT = 0.05


def post_json(url: str, timeout: float) -> Callable[[dict], dict]:
    """A call that posts a JSON object and reads one."""

    def ask(payload: dict) -> dict:
        from urllib import request

        asked = request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"}, method="POST")
        with request.urlopen(asked, timeout=timeout) as answer:
            return json.loads(answer.read())

    return ask


def _attempts(ask: Callable[[dict], dict], payload: str, tries: int, wait: float, until: float) -> tuple[bool, str | None, str | None, int]:
    """(ok, response, error, tries) of a call, repeated after errors while there is time."""
    for n in range(1, tries + 1):
        try:
            return True, json.dumps(ask(json.loads(payload)), sort_keys=True, ensure_ascii=False), None, n
        except Exception as e:  # a failed call is a row, not a failed job
            error = str(e) or type(e).__name__
        if n == tries or time.monotonic() + wait * 2 ** (n - 1) >= until:
            break
        time.sleep(wait * 2 ** (n - 1))
    return False, None, error, n


def called(ask: Callable[[dict], dict], payloads: Iterator[tuple[str, str]], timeout: float, at_once: int, tries: int, wait: float) -> Iterator[tuple]:
    """Rows of CALLS of (key, payload) pairs, as they end; at most ``at_once`` are under way, and one past its deadline makes room for the next."""
    ended: queue.Queue = queue.Queue()
    running: dict[str, tuple[str, float, float]] = {}
    more = True

    def work(key: str, payload: str, until: float) -> None:
        ended.put((key, _attempts(ask, payload, tries, wait, until)))

    while more or running:
        while more and len(running) < at_once:
            pair = next(payloads, None)
            more = pair is not None
            if more:
                running[pair[0]] = (pair[1], time.monotonic(), time.time())
                threading.Thread(target=work, args=(*pair, time.monotonic() + timeout), daemon=True).start()
        try:
            key, result = ended.get(timeout=_WAIT)
            if key in running:  # else it came after its deadline
                payload, begun, clock = running.pop(key)
                yield key, payload, *result, time.monotonic() - begun, clock
        except queue.Empty:
            pass
        for key in [k for k, (_, begun, _) in running.items() if time.monotonic() - begun > timeout]:
            payload, begun, clock = running.pop(key)
            yield key, payload, False, None, f"no answer within {timeout} s", 1, time.monotonic() - begun, clock


class AnswerService:
    """Answers of a service, with its memo and log in a folder; failures are asked again by the next run."""

    def __init__(self, spark: SparkSession, ask: Callable[[dict], dict], folder: str | None = None, timeout: float = 60.0, at_once: int = 8, tries: int = 1, wait: float = 1.0):
        if timeout <= 0 or at_once < 1 or tries < 1:
            raise ValueError("timeout, calls at once and tries must be positive")
        self.spark, self.ask, self.timeout, self.at_once, self.tries, self.wait = spark, ask, timeout, at_once, tries, wait
        self.folder = (folder or storage.new_folder(spark, "answers")).rstrip("/")

    def log(self) -> DataFrame:
        """Every call of every whole run."""
        parts = storage.finished_parts(self.spark, f"{self.folder}/calls")
        return self.spark.read.schema(CALLS).parquet(*parts) if parts else self.spark.createDataFrame([], CALLS)

    def memo(self) -> DataFrame:
        """(key, response) of the requests that were answered."""
        return self.log().where("ok").groupBy("key").agg(F.min_by("response", "called_at").alias("response"))

    def answer(self, requests: DataFrame, payload: str = "payload") -> DataFrame:
        """requests (with a JSON payload) with key, ok, cached, response and error; a null payload has no answer and no key."""
        known = self.memo()
        keyed = requests.withColumn("key", F.sha2(F.col(payload), 256))
        todo = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.first(payload).alias("payload")).join(known.select("key"), "key", "left_anti")
        ask, limits = self.ask, (self.timeout, self.at_once, self.tries, self.wait)

        def run(batches: Iterator[pa.RecordBatch]):
            pairs = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for row in called(ask, pairs, *limits):
                columns = [pa.array([x], kind) for x, kind in zip(row[:7], (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([int(row[7] * 1e6)], pa.timestamp("us", "UTC"))], ["key", "payload", "ok", "response", "error", "tries", "seconds", "called_at"])

        part = storage.write_part(todo.mapInArrow(run, CALLS), f"{self.folder}/calls")
        fresh = self.spark.read.schema(CALLS).parquet(part).select("key", "ok", F.lit(False).alias("cached"), "response", "error")
        before = known.select("key", F.lit(True).alias("ok"), F.lit(True).alias("cached"), "response", F.lit(None).cast("string").alias("error"))
        found = before.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)
        out = keyed.join(found, "key", "left")
        return out.withColumns({"ok": F.coalesce("ok", F.lit(False)), "cached": F.coalesce("cached", F.lit(False))})
