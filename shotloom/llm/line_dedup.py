"""Dropping lines that many documents share, by a sharded minimal perfect hash (operator 12).

Lines are known by the 128-bit BLAKE2 digest of their key. Spark counts the documents of each digest;
lines of fewer than the least number of documents can't be dropped and aren't indexed. The digests of the others fall
into shards of bounded size, each built in a task of its own: a cascade of bit arrays in which every
digest alone at its place gets a bit, those that collide go on to the next, smaller array, and the
rank of a digest's bit is its index. Two dense arrays are in index order: a 64-bit fingerprint, which tells
lines that were never indexed from those that were, and the number of documents.

Documents probe the arrays. Up to ARRAY_BYTES of them, the most frequent lines first, are broadcast after
their size is known, and one pass over the documents answers from them. Lines beyond that are each in few documents;
their probes (distinct digests of a text) are shuffled to the shards, answered there and gathered by text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_DOCS = 10
LEAST_CHARS = 1
#: Lines of a shard, on average.
SHARD = 1 << 15
#: Bytes of arrays that may be broadcast to every Python worker.
ARRAY_BYTES = 64 << 20
#: Bytes of arrays a line takes: fingerprint, count, at most 6 bits of places.
LINE_BYTES = 8 + 8 + 1
#: Probes that a shard answers at a time, on average, where probes are shuffled.
PROBES = 1 << 20
_U = np.uint64
_INNER = ~C.byte_class(0x20, (0x09, 0x0D))


class Lines:
    """The lines of a piece of consecutive texts: row, start and end of each, and start and end of its key."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        breaks = np.flatnonzero(data == 0x0A)
        self.data, self.rows = data, len(off) - 1
        self.per_row = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
        self.row = np.repeat(np.arange(self.rows), self.per_row)
        self.start = np.sort(np.concatenate([off[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, off[1:]]))
        inner = np.flatnonzero(_INNER[data])
        first, last = np.searchsorted(inner, self.start), np.searchsorted(inner, self.end)
        some = first < last
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[some], self.key_end[some] = inner[first[some]], inner[last[some] - 1] + 1

    def digests(self, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lines whose key has that many code points, and their digests as rows of two uint64."""
        heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        which = np.flatnonzero(heads[self.key_end] - heads[self.key_start] >= max(1, least_chars))
        raw = C.LOWER[self.data].tobytes()
        found = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.key_start[which].tolist(), self.key_end[which].tolist(), strict=True)])
        return which, np.frombuffer(found, _U).reshape(-1, 2)


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the number of each row's among them."""
    kind = np.dtype([("a", _U), ("b", _U)])
    found, inverse = np.unique(np.ascontiguousarray(digests).view(kind).ravel(), return_inverse=True)
    return found.view(_U).reshape(-1, 2), inverse.ravel()


def _signed(a: np.ndarray):
    import pyarrow as pa

    return pa.array(a.astype(np.int64))


def line_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b, docs): digests of the line keys in at least least_docs rows of docs (text), with the number of rows."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, data, off in C.text_buffers(batch.column(0)):
                lines = Lines(data, off)
                which, digests = lines.digests(least_chars)
                own, number = _distinct(digests)
                pairs = np.unique(lines.row[which].astype(np.int64) * max(1, len(own)) + number)
                n = np.bincount(pairs % max(1, len(own)), minlength=len(own))
                yield pa.RecordBatch.from_arrays([_signed(own[:, 0]), _signed(own[:, 1]), pa.array(n.astype(np.int64))], ["a", "b", "docs"])

    return docs.select("text").mapInArrow(counted, "a long, b long, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)


class Shard:
    """Minimal perfect hash over the digests of a shard with arrays of fingerprints and counts."""

    def __init__(self, sizes: list[int], places: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.places, self.prints, self.counts = sizes, places, prints, counts
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(places), dtype=np.int64)])

    @staticmethod
    def _at(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (C.mix(digests[:, 0] + C.mix(digests[:, 1] + seed)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray, counts: np.ndarray) -> Shard:
        """digests must be distinct."""
        sizes, places, rest = [], [], np.arange(len(digests))
        order = []
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = cls._at(digests[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            places.append(np.packbits(bits, bitorder="little").view(_U))
            order.append(rest[alone][np.argsort(at[alone])])
            sizes.append(size)
            rest = rest[~alone]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        return cls(sizes, np.concatenate(places) if places else np.zeros(0, _U), digests[at, 1], counts[at])

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Documents of each digest; 0 where it isn't indexed."""
        out, open_, base = np.zeros(len(digests), np.int64), np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._at(digests[open_], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(_U)
            hit = (self.places[word] >> bit) & _U(1) == 1
            index = self.ranks[word] + np.bitwise_count(self.places[word] & ((_U(1) << bit) - _U(1)))
            index, own = index[hit], open_[hit]
            same = self.prints[index] == digests[own, 1]
            out[own[same]] = self.counts[index[same]]
            open_, base = open_[~hit], base + size // 64
        return out


class Index:
    """Shards by number."""

    def __init__(self, shards: dict[int, Shard], count: int):
        self.shards, self.count = shards, count

    def find(self, digests: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digests), np.int64)
        shard = (digests[:, 0] % _U(self.count)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            if (own := self.shards.get(int(shard[rows[0]]))) is not None:
                out[rows] = own.find(digests[rows])
        return out


def _digests_of(table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.int64).view(_U) for c in ("a", "b")], 1)


def _shard(count: int):
    """The unsigned value of a, modulo count."""
    return F.pmod(F.shiftrightunsigned("a", 1) % count * 2 + F.col("a").bitwiseAND(F.lit(1)), F.lit(count)).cast("int")


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, places, prints, counts): one row of arrays for each shard of counts (a, b, docs)."""

    def build(table):
        import pyarrow as pa

        s = Shard.build(_digests_of(table), table.column("docs").to_numpy().astype(np.int64))
        binary = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table([table.column("shard").slice(0, 1), pa.array([s.sizes], pa.list_(pa.int32())), binary(s.places), binary(s.prints), binary(s.counts)], ["shard", "sizes", "places", "prints", "counts"])

    return counts.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, sizes array<int>, places binary, prints binary, counts binary")


def _open(row) -> Shard:
    array = lambda raw, kind: np.frombuffer(bytes(raw), kind)
    return Shard(list(row["sizes"]), array(row["places"], _U), array(row["prints"], _U), array(row["counts"], np.int64))


def _without(docs: DataFrame, dropped) -> DataFrame:
    """docs with the lines that dropped(lines, extra column) names taken out. docs: (doc_id, text[, extra])."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for at, n, data, off in C.text_buffers(batch.column(1)):
                lines = Lines(data, off)
                gone = dropped(lines, batch.column(2).slice(at, n) if batch.num_columns > 2 else None)
                raw = data.tobytes()
                n_gone = np.bincount(lines.row[gone], minlength=n)
                kept = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                begin = np.concatenate([[0], np.cumsum(lines.per_row)])
                for r in np.flatnonzero(n_gone).tolist():
                    own = np.arange(begin[r], begin[r + 1])[~gone[begin[r] : begin[r + 1]]]
                    kept[r] = b"\n".join([raw[a:b] for a, b in zip(lines.start[own].tolist(), lines.end[own].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(lines.per_row.astype(np.int64)), pa.array(n_gone.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return docs.mapInArrow(cut, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def _far(docs: DataFrame, counts: DataFrame, least_chars: int) -> DataFrame:
    """(text_key, far): for texts with lines of counts, the digests of these lines, each as 16 bytes, joined. Probes go to the shards of counts."""

    def probes(batches):
        import pyarrow as pa

        for batch in batches:
            for at, _, data, off in C.text_buffers(batch.column(1)):
                lines = Lines(data, off)
                which, digests = lines.digests(least_chars)
                rows = pa.array(at + lines.row[which])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), _signed(digests[:, 0].view(np.int64)), _signed(digests[:, 1].view(np.int64))], ["text_key", "a", "b"])

    def answer(arrays, asked):
        import pyarrow as pa

        digests = _digests_of(asked)
        hit = np.zeros(len(digests), bool)
        for row in arrays.to_pylist():
            hit = _open(row).find(digests) > 0
        return pa.table([asked.column("text_key").filter(pa.array(hit)), pa.array([d.tobytes() for d in digests[hit]], pa.binary())], ["text_key", "digest"])

    asked = C.cut(docs.select("text_key", "text").mapInArrow(probes, "text_key binary, a long, b long").distinct())
    shards = max(1, counts.count() // SHARD, asked.count() // PROBES)
    found = C.cut(line_index(counts, shards)).groupBy("shard").cogroup(asked.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(answer, "text_key binary, digest binary")
    return found.groupBy("text_key").agg(F.array_join(F.collect_list(F.hex("digest")), "").alias("far"))


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of docs (doc_id, text).

    A text's lines are what stands between its line feeds; a null or empty text is one empty line. A
    line's key is the line without blanks ([\\x20\\x09-\\x0D]) at both ends, A to Z in lower case. Lines
    whose key has at least least_chars code points (1 or more) and is found in at least least_docs rows are dropped
    everywhere; the others stay as they are, joined by line feeds. A line that is repeated in one
    row counts once there. Rows that share a doc_id or have none are documents like others. Empty
    tables give an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    counts = C.cut(line_counts(docs, least_docs, least_chars))
    total, room = counts.count(), max(1, array_bytes // LINE_BYTES)
    far = None
    if total > room:
        # the count that so many lines reach, exactly: its ties stay with the far ones
        steps = counts.groupBy("docs").count().groupBy(F.floor(F.log2(F.col("docs")) * 64).alias("size")).agg(F.sum("count").alias("n"), F.min("docs").alias("docs")).orderBy(F.desc("size")).collect()
        edge, held = float("inf"), 0
        for s in steps:
            held += s.n
            if held > room:
                break
            edge = s.docs
        far = counts.where(F.col("docs") < edge) if edge < float("inf") else counts
        counts = counts.where(F.col("docs") >= edge) if edge < float("inf") else counts.limit(0)
        total = counts.count()
    shards = max(1, total // SHARD)
    arrays = {r["shard"]: _open(r) for r in C.cut(line_index(counts, shards)).collect()}  # array_bytes at most
    near = spark.sparkContext.broadcast(Index(arrays, shards))

    def gone(lines, extra):
        which, digests = lines.digests(least_chars)
        out = np.zeros(len(lines.start), bool)
        own, number = _distinct(digests)
        out[which] = (near.value.find(own) > 0)[number]
        if extra is not None:
            listed = [np.frombuffer(bytes.fromhex(x), _U).reshape(-1, 2) if x else None for x in extra.to_pylist()]
            begin = np.searchsorted(lines.row[which], np.arange(lines.rows + 1))
            for r, found in enumerate(listed):
                if found is not None:
                    a, b = begin[r], begin[r + 1]
                    have = {d.tobytes() for d in found}
                    out[which[a:b]] |= np.fromiter((d.tobytes() in have for d in digests[a:b]), bool, b - a)
        return out

    if far is None:
        return _without(docs.select("doc_id", "text"), gone)
    keyed = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"))
    found = C.cut(_far(keyed, far, least_chars)).withColumnRenamed("text_key", "k")
    return _without(keyed.join(found, F.col("text_key") == F.col("k"), "left").select("doc_id", "text", "far"), gone)


def op12_line_dedup(spark, sf_dir):
    found = drop_repeated_lines(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d USING (r)"""
