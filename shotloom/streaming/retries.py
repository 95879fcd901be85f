"""Delayed retries as state: a failed message waits under its id, and a processing-time timer sends it out when it is due."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and state with an expiry need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RETRY = "event_id long, value string, attempt_header string, handler_failed boolean"
#: How long an attempt that was sent out is remembered, so that one delivered again isn't sent twice.
REMEMBERED_MS = 86_400_000


class Waiting(StatefulProcessor):
    """State of a message: its waiting attempts with the time they are due, and for a day those that were sent."""

    def __init__(self, remembered_ms: int = REMEMBERED_MS):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "attempt int", "value string, failed boolean, due long")
        self.sent = handle.getMapState("sent", "attempt int", "due long", ttlDurationMs=self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for attempt, value, failed, delay in zip(frame.next_attempt, frame.value, frame.handler_failed, frame.delay_seconds, strict=True):
                one = (int(attempt),)
                if self.waiting.containsKey(one) or self.sent.containsKey(one):
                    continue
                due = timerValues.getCurrentProcessingTimeInMs() + int(delay * 1000)
                self.waiting.updateValue(one, (value, bool(failed), due))
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(k[0], v) for k, v in self.waiting.iterator() if v[2] <= now]
        for attempt, v in due:
            self.waiting.removeKey((attempt,))
            self.sent.updateValue((attempt,), (v[2],))
        if due:
            text = lambda c: pd.Series(c, dtype=object)
            yield pd.DataFrame({"event_id": pd.Series([key[0]] * len(due), dtype="int64"), "value": text([v[0] for _, v in due]), "attempt_header": text([str(a) for a, _ in due]), "handler_failed": pd.Series([v[1] for _, v in due], dtype=bool)})

    def close(self) -> None:
        pass


def delayed(failed: DataFrame, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """A stream of retries (event_id, value, attempt_header, handler_failed), each when it is due and once.

    failed: a stream of messages with the route retry, as routing.route() gives them (event_id, value, next_attempt,
    delay_seconds, handler_failed). The session needs STATE_STORE. A batch that is repeated after a crash finds the state of its start, so
    nothing is lost, and what it sends stands in one output batch.
    """
    rows = failed.select("event_id", "value", "handler_failed", "next_attempt", "delay_seconds")
    return rows.groupBy("event_id").transformWithStateInPandas(Waiting(remembered_ms), RETRY, "append", "processingTime")
