"""Packing of real groups against plain best-fit-decreasing."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from shotloom.llm import bin_packing

SCHEMA = "doc_id long, text string"


def plain(sizes, capacity):
    """Rest capacities of the bins of best-fit-decreasing, group by group."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(c, k) for k, c in enumerate(bins) if c >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_runs_fill_the_bins_of_the_plain_version():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.randrange(1, 40) for _ in range(r.randrange(1, 200))]
        runs = bin_packing.best_fit_runs(list(collections.Counter(sizes).items()), 97)
        left = collections.Counter()
        for run in runs:
            for i in range(run.count):
                left[run.bin + i // run.each] += run.size
        assert sorted(97 - v for v in left.values()) == plain(sizes, 97)
        assert collections.Counter({s: sum(x.count for x in runs if x.size == s) for s in sizes}) == collections.Counter(sizes)


def test_a_fixed_capacity_holds_for_every_group_that_fits(spark, monkeypatch):
    monkeypatch.setattr(bin_packing, "BLOCK", 4)
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdef") for _ in range(r.choice((79, 80, 81, r.randrange(20, 400)))))) for i in range(1500)]
    rows += [(5000 + i, rows[i % 7][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.shard for x in bin_packing.pack(docs, capacity=8000).collect()}
    groups, where, load = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for doc, text in rows:
        groups[text] += len(text) + 1
        where[text].add(got[doc])
        load[got[doc]] += len(text) + 1
    assert len(got) == len(rows) and all(len(v) == 1 for v in where.values())
    assert sorted(8000 - v for v in load.values()) == plain(groups.values(), 8000)
    with pytest.raises(ValueError):
        bin_packing.pack(docs, capacity=max(groups.values()) - 1)


def test_shards_of_near_equal_bytes(spark):
    r = random.Random(3)
    rows = [(i, f"{i} " + "x" * int(min(2000, r.paretovariate(1.2) * 20))) for i in range(4000)]
    of = lambda d: sorted(x.s for x in bin_packing.pack(spark.createDataFrame(d, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("s")).collect())
    sizes = of(rows)
    assert len(sizes) == 16 and sizes[-1] - sizes[0] < 0.001 * sizes[-1] + 16
    hot = of([*rows, (9001, "y" * 200_000), (9002, "z" * 200_000), (9003, "y" * 200_000)])  # groups above an equal share
    assert len(hot) == 16 and hot[-2:] == [200_001, 400_002] and hot[-3] - hot[0] < 0.001 * hot[-3] + 16


def test_odd_rows(spark):
    rows = [(None, None), (None, None), (1, None), (1, None), (2, ""), (3, ""), (None, "a"), (4, "a"), (4, "b"), (5, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "2 as slot", "3 as bytes", "4 as h1")
    got = bin_packing.pack(docs, shards=3).collect()
    assert len(got) == len(rows)
    for s in {x.shard for x in got}:
        own = [x.slot for x in got if x.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert len({x.shard for x in got if x.doc_id in (2, 3)}) == 1


def test_very_many_bins_are_few_nodes():
    import tracemalloc

    tracemalloc.start()
    classes = [(510 - k, 20_000) for k in range(500)]  # ten million groups, two or a few to a bin
    runs = bin_packing.best_fit_runs(classes, 1000)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert sum(r.count for r in runs) == 10_000_000 and len(runs) < 20_000
    small = [(s, 25) for s, _ in classes[::5]]
    used = {r.bin + i for r in bin_packing.best_fit_runs(small, 1000) for i in range(-(-r.count // r.each))}
    assert len(used) == len(plain([s for s, n in small for _ in range(n)], 1000))
