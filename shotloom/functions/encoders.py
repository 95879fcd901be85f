"""Extension points: models and tools that callers supply, wrapped as Spark functions.

A factory is called once a Python worker, so a model loads once. Failures of best-effort tools are
data: a struct of value and error, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batched_encoder(load: Callable[[], Callable[[list], list[list[float]]]], dimension: int, batch: int = 32):
    """A column function from texts, frames or clips to vectors of the dimension; other sizes are an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out: list = []
            for i in range(0, len(part), batch):
                vectors = model(part.iloc[i : i + batch].tolist())
                if any(len(v) != dimension for v in vectors):
                    raise ValueError(f"an encoder gave a vector of another dimension than {dimension}")
                out.extend(vectors)
            yield pd.Series(out, index=part.index)

    return encode


def best_effort(tool: Callable, returns: T.DataType, timeout: float | None = None):
    """A column function giving struct(value, error); a call of more than timeout seconds is left behind, with TimeoutError as its row's error."""

    @F.pandas_udf(T.StructType([T.StructField("value", returns), T.StructField("error", T.StringType())]))
    def run(values: pd.Series) -> pd.DataFrame:
        from concurrent.futures import ThreadPoolExecutor

        rows, pool = [], ThreadPoolExecutor(1)
        for v in values:
            try:
                rows.append((tool(v) if timeout is None else pool.submit(tool, v).result(timeout), None))
            except Exception as e:  # the row's failure is its result
                rows.append((None, f"{type(e).__name__}: {e}"))
                if isinstance(e, TimeoutError):  # its thread may go on
                    pool.shutdown(wait=False)
                    pool = ThreadPoolExecutor(1)
        pool.shutdown(wait=False)
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def one_to_many(tool: Callable[[bytes], list[tuple]], fields: str):
    """A table function for transcribers, shot detectors and OCR readers: rows of the given fields for each input."""

    def expand(df, column: str):
        names = [f.name for f in df.schema.fields if f.name != column]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column) + ", pos int, " + fields

        def make(batches):
            for pdf in batches:
                rows = [(*(r[n] for n in names), i, *x) for r in pdf.to_dict("records") for i, x in enumerate(tool(r[column]))]
                yield pd.DataFrame(rows, columns=[*names, "pos", *(f.split()[0] for f in fields.split(","))])

        return df.mapInPandas(make, schema)

    return expand


def require_enabled(enabled: bool, what: str) -> None:
    """Feature gate in front of plan building."""
    if not enabled:
        raise RuntimeError(f"{what} is disabled")
