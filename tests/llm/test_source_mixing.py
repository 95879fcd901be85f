"""The mix against its SQL and a plain selection, with hot sources, many sources and odd rows."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from shotloom.llm import registry, source_mixing
from tests.compare import compare, connect

SCHEMA = "doc_id long, text string, source string"


def test_against_its_sql(spark):
    path, name = "/root/testdata/sf0.001", "op3_source_mixing"
    assert compare(spark, connect(path), path, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_selection_takes_the_least_keys(spark):
    rows = [(i, " ".join(["word"] * (1 + i % 90)), "ab"[i % 3 == 0]) for i in range(900)]
    rows += [(1, "twice here", "c"), (1, "twice here", "c"), (None, "no id", None), (2, None, "c"), (3, "", None), (3, "x y z", "d")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as bucket", "3 as row", "4 as copies")
    got = source_mixing.mix_sources(docs, carry=True)
    assert {len(x.row) for x in got.collect()} == {len(docs.columns)}
    by = collections.defaultdict(list)
    for x in got.collect():
        by[x.source].append(x)
    import hashlib

    for own in by.values():
        def key(x):
            u = (int(hashlib.md5(":".join(["7", *([str(x.doc_id)] if x.doc_id is not None else []), x.text_hash]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            t = x.row.text or ""
            return -math.log(u) / max(0.1, min(1.0, 1.0 * min(1.0, (x.size + 1) / 50) if t else 0.0))

        epochs = int(own[0].target // own[0].source_size) if own[0].source_size else 0
        left, upto = own[0].target - epochs * own[0].source_size, 0
        for x in sorted(own, key=key):
            upto += x.size
            extra = upto <= left or upto - left < left - (upto - x.size)
            assert x.copies == (epochs + extra if x.size else 0)


def test_no_bucket_is_hot(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a ### b").alias("text"), F.lit("s").alias("source"))
    draw = F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string"), F.md5(F.lit("a ### b").cast("binary"))).cast("binary"))
    key = -F.log((F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)) / 0.1
    buckets = rows.select(F.floor(F.log(key) * source_mixing.FINE).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 30


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04}": (k * 37) % 900 for k in range(500)} | {None: 70}
    got = {x.source: x.target for x in source_mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    assert got == pytest.approx(target)
