"""Vector code compression by product quantisation (operator 13).

Components become integers floor(SCALE * x) and all distances are defined on these, so results don't
depend on the order of any sum. Codebooks are 256 entries for each part of the vector, started from
the first vectors and moved by a fixed number of rounds. A round is one pass over the vectors: every
task assigns its vectors and hands on one row of sums for each entry position it met; Spark adds
these up. The driver holds the codebooks alone, whose size is fixed by the vectors' length.

Nearest entries are screened by a float32 matrix product. With u = 2^-24 and w components in a part,
the product x . c is off by at most (w + 4) u / (1 - (w + 4) u) * |x| * |c|, in whatever order it is summed
and with the conversions to float32 included; adding |c|^2 in float32 adds at most u times each operand and the
result. Every entry whose interval overlaps the one of the least upper end is computed again in
int64, and among equal distances the lowest index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components beyond this have no place in 64-bit distances and count as not finite.
LARGEST = float(1 << 15)
CHUNK = 4096
PAIRS = 1 << 16
#: Label totals of up to so many labels (some 40 bytes each) are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000


def edges(dim: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; where dim is no multiple of parts, the first ones are one longer."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    ends = np.cumsum(sizes)
    return [(int(e - s), int(e)) for s, e in zip(sizes, ends, strict=True)]


def _pairs_nearest(x: np.ndarray, book: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Position in book of the nearest entry among those marked in maybe, by int64 distances; ties to the lowest."""
    rows, entries = np.nonzero(maybe)
    d = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), PAIRS):
        diff = x[rows[a : a + PAIRS]] - book[entries[a : a + PAIRS]]
        d[a : a + PAIRS] = np.einsum("ij,ij->i", diff, diff)
    begins = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(d, begins)
    best = np.flatnonzero(d == least[rows])
    return entries[best[np.searchsorted(rows[best], np.arange(len(x)))]]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of book, squared distance) for each row of x; both int64, ties to the lower index."""
    first = np.sort(np.unique(book, axis=0, return_index=True)[1]) if book.shape[1] else np.zeros(1, np.int64)
    own = book[first]  # an equal entry of higher index never wins
    own32, square = own.astype(np.float32), np.einsum("ij,ij->i", own, own)
    u, w = 2.0**-24, book.shape[1] + 4
    gamma = w * u / (1 - w * u)
    longest, top = float(np.sqrt(square.max(initial=0).astype(np.float64))) * (1 + 1e-9), float(square.max(initial=0))
    at, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), CHUNK):
        part = x[a : a + CHUNK]
        score = square.astype(np.float32) - 2 * (part.astype(np.float32) @ own32.T)
        norm = np.sqrt(np.einsum("ij,ij->i", part, part).astype(np.float64)) * (1 + 1e-9)
        radius = (2 * gamma + 5 * u) * norm * longest + 5 * u * top
        limit = np.nextafter((score.min(axis=1) + 2 * radius).astype(np.float32), np.float32(np.inf))
        maybe = score <= limit[:, None]
        found = maybe.argmax(axis=1)
        open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
        if len(open_):
            found[open_] = _pairs_nearest(part[open_], own, maybe[open_])
        diff = part - own[found]
        at[a : a + CHUNK], error[a : a + CHUNK] = first[found], np.einsum("ij,ij->i", diff, diff)
    return at, error


def _integers(column, dim: int) -> np.ndarray:
    """int64 matrix of a list column whose lists are whole and of length dim."""
    import pyarrow as pa

    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64).reshape(-1, dim)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, isn't empty and has finite components only, of magnitude up to LARGEST."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


class Codebooks:
    """The entries of each part: a list of int64 matrices (entry, position)."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.dim = sum(b.shape[1] for b in books)
        self.edges = edges(self.dim, len(books))

    def text(self) -> str:
        return ",".join(str(v) for b in self.books for v in b.ravel())

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for (a, b), book in zip(self.edges, self.books, strict=True):
            part = np.ascontiguousarray(x[:, a:b])
            yield part, *nearest(part, book)


def start(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks from the entries rows of least vec_id (null last, then by vector) of whole vectors; None without any. Their length is the first's."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    dim = vectors.orderBy(*order).select(F.size("embedding")).first()
    if dim is None:
        return None
    rows = vectors.where(F.size("embedding") == dim[0]).orderBy(*order).select("embedding").limit(entries).collect()
    x = np.floor(np.array([r[0] for r in rows], np.float64) * SCALE).astype(np.int64)
    return Codebooks([x[:, a:b].copy() for a, b in edges(dim[0], parts)])


def moved(vectors: DataFrame, now: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry is the floor of the mean of the parts that are nearest to it; unused ones stay."""

    def sums(batches):
        import pyarrow as pa

        total = [np.zeros(b.shape, np.int64) for b in now.books]
        count = [np.zeros(len(b), np.int64) for b in now.books]
        for batch in batches:
            for i, (x, at, _) in enumerate(now.assign(_integers(batch.column(0), now.dim))):
                count[i] += np.bincount(at, minlength=len(count[i]))
                for p in range(x.shape[1]):
                    for a in range(0, len(x), PAIRS):  # sums of so few components are exact in float64
                        total[i][:, p] += np.bincount(at[a : a + PAIRS], x[a : a + PAIRS, p], len(count[i])).astype(np.int64)
        for i, n in enumerate(count):
            used = np.flatnonzero(n)
            width = total[i].shape[1]
            if len(used) and width:
                m = len(used) * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, i, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)), pa.array(total[i][used].ravel()), pa.array(np.repeat(n[used], width))],
                    ["part", "entry", "position", "total", "n"],
                )

    found = vectors.select("embedding").mapInArrow(sums, "part int, entry int, position int, total long, n long")
    books = [b.copy() for b in now.books]
    for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # as many rows as the codebooks have numbers
        books[r.part][r.entry, r.position] = r.total // r.n
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors' columns but for the embedding, with code (two hex digits a part) and error (squared distances summed over the parts)."""
    others = [c for c in vectors.columns if c != "embedding"]

    def codes(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(books.assign(_integers(batch.column(0), books.dim)))
            code = np.stack([at for _, at, _ in found], 1).astype(np.uint8).tobytes().hex()
            wide = 2 * len(found)
            text = [code[i : i + wide] for i in range(0, len(code), wide)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string()), pa.array(sum(e for _, _, e in found))], [*others, "code", "error"])

    schema = ", ".join(f"`{c}` {t}" for c, t in vectors.select(*others).dtypes)
    return vectors.select("embedding", *others).mapInArrow(codes, f"{schema}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every whole vector of vectors (vec_id, embedding, label), and the codebooks.

    Left out: null and empty vectors, those with a null, NaN or infinite component or one beyond
    LARGEST, and those of another length than the whole vector of least vec_id. Rows that share a
    vec_id or have none are rows like others. With fewer than entries whole vectors the codebooks
    have as many entries as there are. A table without whole vectors gives an empty result and no
    codebooks. Extra columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    own = whole_vectors(vectors.select("embedding", "vec_id", "label"))
    books = start(own, parts, entries)
    if books is None:
        return own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    own = own.where(F.size("embedding") == books.dim)
    for _ in range(rounds):
        books = moved(own, books)
    return encode(own, books), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over its label; nulls are one label."""
    totals = C.cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"))
    side = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    return codes.join(side, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def op13_vector_codes(spark, sf_dir):
    codes, books = vector_codes(C.table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return with_label_error(C.cut(codes)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other."""
    steps = [
        f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + entry) AS best FROM p JOIN b{i} USING (part) GROUP BY p.r, p.part)")
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, best % {entries} AS entry, unnest(range(len(x))) AS pos, unnest(x) AS v FROM p JOIN a{i} USING (r, part)) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - (((s % n) + n) % n)) // n ORDER BY pos) AS c FROM s{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
            )
    last = rounds
    return (
        ",\n".join(steps)
        + f""",
e AS (SELECT r, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN kept USING (r), h"""
    )


ORACLE = _oracle()
