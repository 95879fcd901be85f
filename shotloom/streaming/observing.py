"""Metrics of batches and streams on their way: observed aggregates feed counters that a scrape reads as text."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.metrics import exposed, exposition


class Counters(StreamingQueryListener):
    """Counters by name and label, fed by observed() batches and, once added to the session's streams, by every batch of a stream that observes the same name.

    An aggregate's name is its label. The aggregates run inside the job that writes the rows; no pass over the data is added, and the driver holds one
    number for each name and label.
    """

    def __init__(self) -> None:
        self.values: dict[tuple[str, str], float] = {}
        self.lock = threading.Lock()
        self.open: list[tuple[str, Observation]] = []

    def add(self, name: str, row: dict) -> None:
        with self.lock:
            for label, n in row.items():
                self.values[name, label] = self.values.get((name, label), 0) + (n or 0)

    def observed(self, df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
        """df, whose next action counts under name; in a stream each batch does."""
        columns = [c.alias(k) for k, c in aggregates.items()]
        if df.isStreaming:
            return df.observe(name, *columns)
        seen = Observation(name)
        self.open.append((name, seen))
        return df.observe(seen, *columns)

    def collect(self) -> None:
        """Takes the numbers of the batches that have run. Call it after their action; it waits for one that hasn't."""
        while self.open:
            name, seen = self.open.pop()
            self.add(name, seen.get)

    def text(self, spark, help_texts: dict[str, str] | None = None) -> str:
        with self.lock:
            held = sorted(self.values.items())
        parts = []
        for name in sorted({n for (n, _), _ in held}):
            rows = [(label, int(v)) for (n, label), v in held if n == name]
            parts.append(exposition(name, "counter", spark.createDataFrame(rows, "outcome string, n long"), (help_texts or {}).get(name, "")))
        return exposed(*parts)

    # ------------------------------------------------------------ the listener's side

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.add(name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def outcomes(column: str, *names: str) -> dict[str, Column]:
    """Aggregates that count the rows of each outcome."""
    return {n: F.count_if(F.col(column) == n) for n in names}
