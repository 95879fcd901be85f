"""Shared helpers: table access, lineage cuts in shared storage, and NumPy text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of one word character: everything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_LOCAL = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary one (tests); on a cluster that raises, as executors share no local folder."""
    global _LOCAL
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="shotloom-")
    return root


def clear(spark: SparkSession) -> None:
    """Deletes all work tables. Call it when the results that read them are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shotloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to shared storage and reads it back, so a lost executor never means recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shotloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name beginning with stem that df doesn't have, whatever the case."""
    held = {c.lower() for c in df.columns}
    while stem.lower() in held:
        stem += "_"
    return stem


def words_of(text) -> F.Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text) -> F.Column:
    """Number of words. The runs of non-space characters collapse to one mark each."""
    return F.size(words_of(text)).cast("long")


# ---------------------------------------------------------------- NumPy kernels

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, _U)
_INV = np.ones(1, _U)
_TABLE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
PIECE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_POW", _BASE), ("_INV", inverse)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=_U)
    return _POW, _INV


def byte_class(*members) -> np.ndarray:
    """Lookup table over the 256 byte values; members are ints or inclusive pairs."""
    out = np.zeros(256, bool)
    for m in members:
        lo, hi = m if isinstance(m, tuple) else (m, m)
        out[lo : hi + 1] = True
    return out


WORD_BYTES = ~byte_class(0x20, (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column):
    """Yields (first row, row count, bytes, row offsets) over an Arrow string column in pieces of bounded size; null rows are empty."""
    import pyarrow as pa

    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        n = len(part)
        if not n:
            continue
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + 4 * PIECE, "right")) - 1)
            b = min(b, n)
            yield a, b - a, data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of inside bytes, cut at row offsets."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside
    starts = np.flatnonzero((flag[1:] == 1) & (flag[:-1] == 0))
    ends = np.flatnonzero((flag[1:] == 0) & (flag[:-1] == 1))
    at = off[1:-1]
    at = np.unique(at[(at > 0) & (at < len(data))])
    at = at[(flag[at] == 1) & (flag[at + 1] == 1)]  # a run goes over a row's edge here
    if len(at):
        starts = np.sort(np.concatenate([starts, at]))
        ends = np.sort(np.concatenate([ends, at]))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of bytes, from prefix sums of a polynomial, piece by piece."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        b = int(ends[j - 1])
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, _U)
        np.cumsum(_TABLE[data[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
        i = j
    return out


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, in order; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, k, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
