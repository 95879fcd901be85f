"""Structured Streaming: routing with retries, and a circuit breaker kept as state.

The routing function is the batch one. Batches are at least once; sinks are written by batch id, so
a replay overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators.routing import FAILURES, OPEN_SECONDS, route

MESSAGE = "event_id long, value string, attempt_header string, handler_failed boolean"
#: Sinks of a message's route.
SINKS = {"done": "completed", "retry": "retry", "failed": "dead_letter", "dead_letter": "dead_letter"}


def messages(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A queue as a folder of JSON files; files_per_batch is the prefetch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)


def route_stream(stream: DataFrame, out: str, checkpoint: str):
    """Starts the query that sends each message to completed, retry or dead_letter below out, and events beside them.

    Retry rows carry not_before; read them again with due_retries().
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = route(batch).withColumn("not_before", F.when(F.col("route") == "retry", F.timestamp_add("SECOND", F.col("delay_seconds"), F.current_timestamp()))).persist()
        try:
            for sink in sorted(set(SINKS.values())):
                names = [k for k, v in SINKS.items() if v == sink]
                rows.where(F.col("route").isin(names)).write.mode("overwrite").parquet(f"{out}/{sink}/batch={batch_id}")
            rows.where("event is not null").select("event_id", "event", "attempt").write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_retries(spark: SparkSession, out: str, now) -> DataFrame:
    """Messages of the retry sink whose time has come and that are not acknowledged, with the next attempt as their header.

    Until acknowledged they come again, so a handler that dies loses nothing.
    """
    rows = spark.read.parquet(f"{out}/retry").where(F.col("not_before") <= now)
    due = rows.select("event_id", "value", F.col("next_attempt").cast("string").alias("attempt_header"), "handler_failed")
    try:
        taken = spark.read.parquet(f"{out}/retry_acknowledged")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return due
    return due.join(taken, ["event_id", "attempt_header"], "left_anti")


def acknowledge(handled: DataFrame, out: str) -> None:
    """Marks due retries (event_id, attempt_header) as handled, so that due_retries gives them no more."""
    handled.select("event_id", "attempt_header").write.mode("append").parquet(f"{out}/retry_acknowledged")


_STATE = "fails int, opened double"
_ANSWER = "key string, seq long, state string, allowed boolean"


def breaker_stream(calls: DataFrame) -> DataFrame:
    """(key, seq, state, allowed) of a stream of calls (key, seq, t, failed). State per key: failures in a row and the time it opened."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fails, opened = state.get if state.exists else (0, float("nan"))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, t, failed in zip(rows.seq, rows.t, rows.failed, strict=True):
            is_open = opened == opened
            if is_open and t < opened + OPEN_SECONDS:
                out.append((key[0], seq, "open", False))
                continue
            out.append((key[0], seq, "half-open" if is_open else "closed", True))
            fails = fails + 1 if failed else 0
            opened = t if failed and (is_open or fails >= FAILURES) else float("nan")
        state.update((int(fails), float(opened)))
        yield pd.DataFrame(out, columns=["key", "seq", "state", "allowed"])

    return calls.groupBy("key").applyInPandasWithState(step, _ANSWER, _STATE, "append", "NoTimeout")
