"""Message validation and routing, shared by batch and streaming, and the circuit breaker as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import merged_maps
from ..schemas import REQUEST_KEYS
from .ordered import in_parts, largest_before, running_sums

#: Attempts, delays in seconds, and kinds of a request. Fixed values.
MAX_ATTEMPTS, DELAYS = 3, (30, 120, 600)
REQUEST_KINDS = ("Video", "Audio", "Image")
#: Consecutive failures that open the breaker, and seconds until it tries again. Fixed values.
FAILURES, OPEN_SECONDS = 5, 10.0


def attempt_of(header: Column) -> Column:
    return F.coalesce(header.try_cast("int"), F.lit(0))


def request_error(value: Column) -> Column:
    """Why a message is invalid, or null: bad JSON, an unknown key, no media id, an unknown kind."""
    keys = F.json_object_keys(value)
    return F.when(keys.isNull(), "json").when(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in REQUEST_KEYS)))) > 0, "unknown key").when(F.coalesce(F.get_json_object(value, "$.mediaId"), F.lit("")) == "", "media id").when(~F.coalesce(F.get_json_object(value, "$.kind"), F.lit("")).isin(*REQUEST_KINDS), "kind")


def route(messages: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds attempt, error, route, next_attempt, delay_seconds and event.

    Invalid messages are dead-lettered without an event. A failed handler retries while attempts are
    left, with the delay of its attempt; then a failed event goes out and the message is dead-lettered.
    """
    attempt = attempt_of(F.col("attempt_header"))
    error = request_error(F.col("value"))
    failed = F.coalesce("handler_failed", F.lit(False))
    path = F.when(error.isNotNull(), "dead_letter").when(~failed, "done").when(attempt + 1 < max_attempts, "retry").otherwise("failed")
    delay = F.get(F.array(*(F.lit(d) for d in DELAYS)), F.least(attempt, F.lit(len(DELAYS) - 1)))
    return messages.withColumns({"attempt": attempt, "error": error, "route": path}).withColumns({
        "next_attempt": F.when(F.col("route") == "retry", F.col("attempt") + 1),
        "delay_seconds": F.when(F.col("route") == "retry", delay),
        "event": F.when(F.col("route") == "done", "completed").when(F.col("route") == "failed", "failed"),
    })


def started_events(messages: DataFrame) -> DataFrame:
    """One started event for each valid message of a batch, again on each retry."""
    return messages.where(request_error(F.col("value")).isNull()).select("event_id", F.lit("started").alias("event"), attempt_of(F.col("attempt_header")).alias("attempt"))


def stamped_headers(headers: Column, attempt: Column, error: Column) -> Column:
    """Retry headers win over those present; the first error stays."""
    first = F.create_map(F.lit("x-first-error"), error)
    return merged_maps(first, F.coalesce(headers, F.create_map().cast("map<string,string>")), F.create_map(F.lit("x-attempt"), attempt.cast("string"), F.lit("x-last-error"), error))


def breaker_states(calls: DataFrame) -> DataFrame:
    """(key, seq, state, allowed) of ordered calls (key, seq, t, failed) through a breaker per key; seq tells a key's calls apart.

    A success OPEN_SECONDS or more after every earlier call always finds the breaker willing and leaves it closed without
    failures, so what follows it is a run of its own. Each run passes by in order, batch by batch, with
    two numbers of state; none are gathered. A key is as many tasks as it has runs; one that never
    has such a success is a single one. Calls without a t count as made while the breaker isn't waiting.
    """

    def step(batches):
        import pandas as pd

        own, fails, opened = object(), 0, None
        for batch in batches:
            out = []
            for k, run, seq, t, failed in batch[["key", "run", "seq", "t", "failed"]].itertuples(index=False):
                if (k, run) != own:
                    own, fails, opened = (k, run), 0, None
                if opened is not None and t < opened + OPEN_SECONDS:
                    out.append((k, seq, "open", False))
                    continue
                out.append((k, seq, "closed" if opened is None else "half-open", True))
                probe, fails = opened is not None, fails + 1 if failed else 0
                opened = t if failed and (probe or fails >= FAILURES) else None
            yield pd.DataFrame(out, columns=["key", "seq", "state", "allowed"])

    types = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    rows = largest_before(in_parts(calls.select("key", "seq", "t", "failed"), ["key"], ["seq"]), ["key"], ["seq"], "t", "latest")
    quiet = F.coalesce(F.col("t") >= F.col("latest") + OPEN_SECONDS, F.lit(True))
    rows = rows.withColumn("reset", (quiet & ~F.coalesce("failed", F.lit(False))).cast("long"))
    # the success itself still belongs to the run before it
    rows = running_sums(rows, ["key"], ["seq"], run="reset").withColumn("run", F.col("run") - F.col("reset"))
    rows = rows.repartition("key", "run").sortWithinPartitions("key", "run", "seq")
    return rows.mapInPandas(step, f"key {types['key']}, seq {types['seq']}, state string, allowed boolean")
