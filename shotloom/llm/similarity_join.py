"""N-gram Jaccard join by vertical partitioning (operator 10).

The global order of all n-grams is (frequency level, hash). Levels come from hashed counters over
the whole corpus, whose number grows with the text up to what an executor holds; any total order
gives whole results, a good one only makes them cheap. Rows with equal n-gram sets form a class,
named by a row number that is written with it, and only classes are joined.

1. Every class sends the n-grams of its prefix in the global order to their posting lists. Two sets
   of the wanted similarity share at least one.
2. Star round: in each list, members are paired with the list's first member and with their
   predecessor, which is linear in the list. Pairs that hold are joined to components.
3. Rest round: members of one list that are in different components are paired where sizes,
   positions and parity maps allow the similarity (all three are bounds, none loses a link). The set
   that isn't larger takes part with a shorter prefix only, which holds their first common n-gram. No
   pair is inside the list's largest component, so a list that is nearly one component stays cheap.
4. Every pair is held against wider parity maps, as many bits as the sets have n-grams.
5. Verification cuts the global order into fragments of equal mass. Each document's fragments are
   written once; each fragment counts its part of a pair's overlap by itself, and the partial counts
   are summed per pair and tested exactly.

Pairs inside one component are not enumerated, so a large group of near copies costs its size,
not its square. A posting list that holds very many classes is salted.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

#: Least and most hashed counters for the global order, as powers of two; the most take 64 MB on an executor.
COUNTER_BITS = (16, 26)
#: Bytes of text for each counter between the two.
COUNTED_BYTES = 64
BLOCK = 1 << 18
#: Fragments of the hash order in verification.
FRAGMENTS = 8
#: Classes of one posting list that share a salt, and how often the mean count at least, so that only lists that stand out are salted.
SALT_ROWS, SALT_MEANS = 100_000, 8
#: N-grams that a task holds before it passes them on.
HELD = 500_000
#: Candidate pairs are broadcast up to this number, 16 MB; beyond it the join shuffles.
BROADCAST_PAIRS = 250_000


def shingle_sets(column, n: int):
    """Yields (row, sorted distinct n-gram hashes) for every row of an Arrow string column."""
    for first, rows, data, off in C.text_buffers(column):
        data = C.LOWER[data]
        starts, ends = C.spans(data, off, C.WORD_BYTES[data])
        hashes = C.span_hashes(data, starts, ends)
        grams = C.rolling(hashes, n)
        edge = np.searchsorted(starts, off)
        for r in range(rows):
            a, b = edge[r], edge[r + 1]
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                yield first + r, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield first + r, C.rolling(hashes[a:b], int(b - a))
            else:
                yield first + r, np.zeros(0, np.uint64)


class GlobalOrder(NamedTuple):
    """Level of each hashed counter, floor(log2(count / mean count)) and at least 0; the mean count; and where the order is cut: (level, hash) of each fragment but the first."""

    level: np.ndarray
    mean: float
    cuts: list[tuple[int, int]]

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.level[(grams & np.uint64(len(self.level) - 1)).astype(np.int64)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        own, out = self.of(grams), np.zeros(len(grams), np.int32)
        for level, least in self.cuts:
            out += (own > level) | ((own == level) & (grams >= np.uint64(least)))
        return out


def _cuts(mass: dict[int, int], fragments: int) -> list[tuple[int, int]]:
    """Where an order of levels with so many n-grams each, hashes spread evenly, falls into parts of equal mass."""
    total, out = sum(mass.values()), []
    for k in range(1, fragments):
        left = total * k / fragments
        for level in sorted(mass):
            if left < mass[level]:
                out.append((level, int(left / mass[level] * (1 << 64))))
                break
            left -= mass[level]
    return out


def counter_bits(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(int(total // COUNTED_BYTES).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])


def global_order(docs: DataFrame, n: int, bits: int | None = None, fragments: int = FRAGMENTS) -> GlobalOrder:
    """The order from the counts of all n-grams; the driver gets one compressed byte a counter, nearly all of them 0."""
    size = 1 << (bits or counter_bits(docs))
    block = min(BLOCK, size)

    def count(batches):
        import pyarrow as pa

        total, parts, held = np.zeros(size, np.uint16), [], 0

        def flush():
            if parts:
                at, times = np.unique(np.concatenate(parts), return_counts=True)
                total[at] = np.minimum(total[at].astype(np.int64) + times, 65535)  # a level may come out lower, no more
                parts.clear()

        for batch in batches:
            for _, own in shingle_sets(batch.column(0), n):
                parts.append((own & np.uint64(size - 1)).astype(np.int32))
                held += len(own)
                if held >= 1 << 20:
                    flush()
                    held = 0
        flush()
        for k in range(size // block):
            own = total[k * block : (k + 1) * block]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["block", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint16)
                sums[k] = sums.get(k, 0) + own.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], ["block", "counts", "total"])

    summed = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(max(1, size // block // 2), "block")
    summed = C.cut(summed.mapInArrow(add, "block int, counts binary, total long"))
    mean = max(1.0, (summed.agg(F.sum("total")).first()[0] or 0) / size)

    def rank(batches):
        import pyarrow as pa

        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.uint64)
                level = np.floor(np.log2(np.maximum(own / mean, 1))).astype(np.uint8)
                mass = np.zeros(64, np.int64)
                np.add.at(mass, level, own.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([mass], pa.list_(pa.int64()))], ["block", "level", "mass"])

    level, mass = np.zeros(size, np.uint8), np.zeros(64, np.int64)
    for k, own, part in summed.select("block", "counts").mapInArrow(rank, "block int, level binary, mass array<long>").collect():  # a row for each block
        level[k * block : (k + 1) * block] = np.frombuffer(zlib.decompress(own), np.uint8)
        mass += np.array(part)
    return GlobalOrder(level, mean, _cuts({int(k): int(mass[k]) for k in np.flatnonzero(mass)}, fragments))


_PROFILE = "t long, n long, s1 long, s2 long, wide binary, bits array<long>, prefix array<long>, salts array<int>"


def parity_map(own: np.ndarray) -> np.ndarray:
    """Parity of the n-grams of each hash class, as bytes; the classes are a power of two, 512 and the set's size at least."""
    classes = max(512, 1 << int(len(own) - 1).bit_length()) if len(own) else 512
    at = (own >> np.uint64(20)).astype(np.int64) & (classes - 1)
    return np.packbits((np.bincount(at, minlength=classes) & 1).astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The map as if made with fewer classes (size in bytes)."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _profiles(docs: DataFrame, n: int, percent: int, order) -> DataFrame:
    """One row for each of docs (doc_id, t, text): set size, 128-bit signature, parity map and its fold to 512 bits, and the prefix in the global order with the salt count of each."""

    def make(batches):
        import pyarrow as pa

        known = order.value
        share = max(SALT_ROWS, SALT_MEANS * known.mean)
        names = ["n", "s1", "s2", "wide", "bits", "prefix", "salts"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))

        def rows(batch, at, cols):
            own = batch.take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "t", *names])

        for batch in batches:
            ids = batch.select(["doc_id", "t"])
            at, cols, held = [], tuple([] for _ in names), 0
            for r, own in shingle_sets(batch.column(2), n):
                size = len(own)
                need = (percent * size + 99) // 100
                wide = parity_map(own)
                lev = known.of(own)
                first = np.argsort(lev, kind="stable")[: size - need + 1] if size else np.zeros(0, np.int64)
                salts = np.maximum(1, np.exp2(lev[first].astype(np.float64) + 1) * known.mean / share)
                at.append(r)
                for c, v in zip(cols, (size, own.sum(dtype=np.uint64).astype(np.int64) if size else 0, np.bitwise_xor.reduce(C.mix(own)).astype(np.int64) if size else 0, wide.tobytes(), folded(wide, 64).view(np.int64), own[first].astype(np.int64), salts.astype(np.int32)), strict=True):
                    c.append(v)
                held += size
                if held > HELD:
                    yield rows(ids, at, cols)
                    at, cols, held = [], tuple([] for _ in names), 0
            if at:
                yield rows(ids, at, cols)

    return docs.select("doc_id", "t", "text").mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_PROFILE}")


def _possible(a: str, b: str, percent: int, positions: bool = True) -> F.Column:
    """Bounds that two sets of the wanted similarity satisfy: sizes, and positions of their first common n-gram."""
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    ok = least * 100 >= most * percent
    if positions:
        ok = ok & (F.col(f"{a}.pos") + F.col(f"{b}.pos") <= _apart(a, b, percent))
    return ok


def _apart(a: str, b: str, percent: int) -> F.Column:
    """Most n-grams that may be in one set only."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return both - 2 * F.floor((both * percent + 99 + percent) / (100.0 + percent))


def _maps_allow(a: str, b: str, percent: int) -> F.Column:
    """Each n-gram in one set only flips one bit of the maps' difference at most."""
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(8)), F.lit(0))
    return differ <= _apart(a, b, percent)


def _pruned(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the wide maps allow, with sizes na and nb; written to shared storage."""

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            most = na + nb - 2 * (((na + nb) * percent + 99 + percent) // (100 + percent))
            good = []
            for x, y, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(u), len(v))
                good.append(int(np.bitwise_count((folded(u, size) ^ folded(v, size)).view(np.uint64)).sum()) <= d)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(good, pa.bool_()))

    x = maps.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    y = maps.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y")
    return C.cut(both.mapInArrow(keep, "a long, b long, na long, nb long"))


def _fragments(docs: DataFrame, wanted: DataFrame, few: bool, n: int, order) -> DataFrame:
    """(cls, fragment, grams) of the rows of docs that wanted (doc_id, t, cls) names; each is cut up once, whatever the pairs it is in. Written to shared storage."""

    def cut_up(batches):
        import pyarrow as pa

        known = order.value
        names = ["cls", "fragment", "grams"]

        def rows(out):
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            cls = batch.column(1).to_pylist()
            out, held = tuple([] for _ in names), 0
            for r, own in shingle_sets(batch.column(0), n):
                part = known.fragment(own)
                own, part = own[by := np.argsort(part, kind="stable")], part[by]
                edge = np.searchsorted(part, np.arange(FRAGMENTS + 1))
                for f in range(FRAGMENTS):
                    if edge[f] < edge[f + 1]:
                        for c, v in zip(out, (cls[r], f, own[edge[f] : edge[f + 1]].view(np.int64)), strict=True):
                            c.append(v)
                held += len(own)
                if held > HELD:
                    yield rows(out)
                    out, held = tuple([] for _ in names), 0
            if out[0]:
                yield rows(out)

    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("t2"))
    own = wanted.select(F.col("doc_id").alias("id"), F.col("t").alias("t2"), "cls")
    found = docs.join(F.broadcast(own) if few else own, same).select("text", "cls").mapInArrow(cut_up, "cls long, fragment int, grams array<long>")
    return C.cut(found.dropDuplicates(["cls", "fragment"]))  # a row may be repeated


def _verified(docs: DataFrame, heads: DataFrame, pairs: DataFrame, n: int, percent: int, order) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) whose similarity holds; overlaps are counted in each fragment of the order and summed."""
    few = pairs.count() <= BROADCAST_PAIRS
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    parts = _fragments(docs, heads.select("doc_id", "t", "cls").join(F.broadcast(ends) if few else ends, "cls", "left_semi"), few, n, order)
    own = pairs.select("a", "b")
    left = parts.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("x")).join(F.broadcast(own) if few else own, "a")
    part = left.join(parts.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("y")), ["b", "fragment"])
    part = part.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("part"))
    total = part.groupBy("a", "b").agg(F.sum("part").alias("both")).join(pairs, ["a", "b"])
    return total.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of different texts under one doc_id."""
    sig = F.struct("n", "s1", "s2")
    rows = rows.where("n > 0 and doc_id is not null").select("doc_id", sig.alias("sig"))
    several = rows.groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("doc_id", "lo")
    named = classes.select(F.struct("n", "s1", "s2").alias("sig"), "cls")
    links = rows.join(several, "doc_id").where("sig > lo").select("sig", "lo").distinct()
    return links.join(named.withColumnRenamed("cls", "a"), "sig").join(named.select(F.col("sig").alias("lo"), F.col("cls").alias("b")), "lo").select("a", "b")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Sets hold the distinct n-word shingles of the text with A-Z lower-cased; a text of fewer words
    is one shingle; null, empty and blank texts have an empty set and link with nothing. Documents
    link when 100 * intersection >= percent * union. component_id is the least doc_id reachable.
    Repeated rows keep their number. Rows with words that share a doc_id are one document, so their
    texts are in one component. A null doc_id is no shared one: such a row links by its text alone,
    and component_id is null if no row it reaches has an id. Extra columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    order = spark.sparkContext.broadcast(global_order(docs, n))
    # row numbers hold once they are written
    all_rows = C.cut(_profiles(docs, n, percent, order).withColumn("rid", F.monotonically_increasing_id()))
    classes = C.cut(all_rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("least")))
    heads = all_rows.join(classes.select("cls"), F.col("rid") == F.col("cls")).drop("rid")
    posts = heads.select("cls", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "x")).select("cls", "n", "pos", F.col("x.prefix").alias("gram"), F.when(F.col("x.salts") > 1, F.pmod(F.xxhash64("cls"), F.col("x.salts"))).otherwise(0).cast("int").alias("salt"), (F.col("x.salts") > 1).alias("salted"))
    own = Window.partitionBy("gram", "salt").orderBy("pos", "cls")
    me = F.struct("cls", "n", "pos")
    lists = posts.select("*", F.lag(me).over(own).alias("last"), F.first(me).over(own).alias("head"), F.lead("cls").over(own).alias("next"))
    # alone in its part of a salted list, a row may still have neighbours in the other parts
    lists = C.cut(lists.where("last is not null or next is not null or salted").drop("next", "salted"))
    across = lists.where("last is null and salt >= 0").join(lists.where("salt > 0").select("gram").distinct(), "gram", "left_semi")
    wide = Window.partitionBy("gram").orderBy("pos", "cls")
    across = across.select("*", F.lag(me).over(wide).alias("near")).where("near is not null").select(F.col("near").alias("x"), me.alias("y"))
    star = lists.where("last is not null").select(F.explode(F.array("last", "head")).alias("x"), me.alias("y")).unionByName(across)
    star = star.where("x.cls <> y.cls").where(_possible("x", "y", percent))
    star = star.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    maps = C.cut(heads.select("cls", "doc_id", "t", "n", "wide", "bits"))
    star = _pruned(star, maps, percent)
    links = C.cut(_verified(docs, maps, star, n, percent, order))
    found = C.cut(connected_components(links))

    members = lists.select("gram", "cls", "n", "pos").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = members.groupBy("gram", "component").agg(F.count("*").alias("held")).groupBy("gram")
    mixed = mixed.agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.sum("held").alias("held"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("gram", "main", (F.floor(F.col("held") / SALT_ROWS) + 1).cast("int").alias("salts"))
    members = members.join(mixed, "gram").withColumn("off", F.col("component") != F.col("main")).join(maps.select("cls", "bits"), "cls")
    members = members.select("gram", "cls", "component", "off", "salts", F.struct("n", "pos", "bits").alias("v"))
    # the first common n-gram of two linked sets is in the shorter prefix of the one that isn't larger; "off" pairs rows of
    # the list's largest component with others only
    short = members.where(F.expr(f"v.pos <= v.n - ({2 * percent} * v.n + {99 + percent}) div {100 + percent}"))
    x = short.select("gram", "off", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("cls").alias("a"), F.col("component").alias("ca"), F.col("v").alias("x"))
    sides = F.explode(F.when(F.col("off"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("off")
    y = members.select("gram", sides, F.pmod(F.xxhash64("cls"), "salts").cast("int").alias("salt"), F.col("cls").alias("b"), F.col("component").alias("cb"), F.col("v").alias("y"))
    larger = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("a") < F.col("b")))
    rest = x.join(y, ["gram", "off", "salt"]).where((F.col("ca") != F.col("cb")) & larger & _possible("x", "y", percent) & _maps_allow("x", "y", percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    more = C.cut(_verified(docs, maps, _pruned(rest, maps, percent), n, percent, order))
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected_components(known.unionByName(more).unionByName(_shared_ids(all_rows, classes)))

    named = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = C.cut(named.select("n", "s1", "s2", "component", "least"))
    named = named.drop("least").join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component")
    out = all_rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE a = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""
