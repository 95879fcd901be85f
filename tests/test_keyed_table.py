"""The merge-on-read table against the plan that replaces by key, and the index writer's transactions."""

import pytest
from pyspark.sql import functions as F

from shotloom.operators import keyed_table as K
from shotloom.operators import stores

SCHEMA = "k long, v string"


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


def test_content_equals_replace_by_key_before_and_after_compaction(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 8)
    assert rows(t.content()) == [] and t.compact() is None
    base = spark.range(1000).select((F.col("id") % 200).alias("k"), F.concat(F.lit("a"), "id").alias("v"))
    t.replace(base)
    want = base
    steps = [
        (spark.range(30).select((F.col("id") % 7).alias("k"), F.concat(F.lit("b"), "id").alias("v")), spark.range(9).select(F.col("id").alias("k"))),
        (spark.createDataFrame([], SCHEMA), spark.range(100, 120).select(F.col("id").alias("k"))),
        (spark.createDataFrame([(3, "c"), (3, "c"), (500, None), (None, "d")], SCHEMA), spark.createDataFrame([(3,), (500,), (3,)], "k long")),
    ]
    for new, keys in steps:
        t.replace(new, keys)
        want = stores.replace_by_key(want, new, keys, "k")
        assert rows(t.content()) == rows(want)
    some = spark.createDataFrame([(3,), (110,), (7,)], "k long")
    assert rows(t.content(keys=some)) == rows(want.join(some, "k", "left_semi"))
    assert t.compact({0, 1}) and rows(t.content()) == rows(want)
    assert t.compact() and rows(t.content()) == rows(want)
    new = spark.createDataFrame([(7, "late")], SCHEMA)
    t.replace(new)
    assert rows(t.content()) == rows(stores.upsert(want, new, "k"))
    assert t.vacuum(0) == 4 and rows(t.content()) == rows(stores.upsert(want, new, "k"))


def test_one_key_writes_and_reads_one_bucket(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 16)
    t.replace(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    t.replace(spark.createDataFrame([(5, "b")], SCHEMA))
    assert [len(e.buckets) for e in t.entries()] == [16, 1]
    one = t.content(keys=spark.createDataFrame([(5,)], "k long"))
    assert rows(one) == [(5, "b")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [kt_bucket") + plan.count("PartitionFilters: [isnotnull(kt_bucket") == plan.count("PartitionFilters: [") >= 2


def test_a_batch_is_applied_once_and_writers_never_share_a_version(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    new = spark.createDataFrame([(1, "a")], SCHEMA)
    assert t.replace(new, batch="b1") == t.replace(new, batch="b1") == 1
    stale = K.KeyedTable(spark, t.path, SCHEMA, "k", 4)
    stale.log.entries = lambda: []  # a writer that hasn't seen the first version
    assert stale._commit("x" * 32, "delta", []) == 2
    assert [e.version for e in t.entries()] == [1, 2] and rows(t.content()) == [(1, "a")]


def test_one_wrong_dimension_leaves_the_former_points(spark, tmp_path):
    schema = "point_id string, media_id string, collection string, vector array<double>"
    t = K.KeyedTable(spark, str(tmp_path / "p"), schema, "media_id", 8)
    dims = {"transcript": 2, "ocr": 3}
    made = lambda n, v: spark.createDataFrame([(f"{v}{i}", f"m{i % 5}", "transcript", [1.0, float(i)]) for i in range(n)], schema)
    media = lambda *m: spark.createDataFrame([(x,) for x in m], "media_id string")
    K.write_points(t, made(50, "a"), media(*(f"m{i}" for i in range(5))), dims)
    ids = lambda: sorted(r.point_id for r in t.content().collect())
    first = ids()
    for bad in (("x", "m1", "ocr", [1.0, 2.0]), ("x", "m1", "ocr", None), ("x", "m1", "smell", [1.0]), ("x", "m1", None, [1.0])):
        wrong = made(40, "b").unionByName(spark.createDataFrame([bad], schema)).repartition(6)
        with pytest.raises(Exception, match="dimension|unknown collection"):
            K.write_points(t, wrong, media("m0", "m1"), dims)
        assert ids() == first and len(t.entries()) == 1
    new = made(40, "b").where("media_id = 'm1'")
    K.write_points(t, new, media("m0", "m1"), dims)
    after = ids()
    assert after == sorted([x for x in first if int(x[1:]) % 5 > 1] + [f"b{i}" for i in range(40) if i % 5 == 1])
    K.write_points(t, new, media("m0", "m1"), dims)
    assert ids() == after
    K.write_points(t, made(0, "c"), media("m2", "m3", "m4", "m1", "none"), dims)
    assert ids() == []
    assert t.vacuum(0) == 0  # all committed writes still count; the failed ones left no files


def test_whole_contents_are_numbered_and_old_ones_removed(spark, tmp_path):
    at = str(tmp_path / "w")
    made = [spark.createDataFrame([(i, f"v{i}")], SCHEMA) for i in range(4)]
    assert [stores.write_replaced(m, at, "k") for m in made] == [1, 2, 3, 4]
    assert rows(stores.read_replaced(spark, at)) == [(3, "v3")] and rows(stores.read_replaced(spark, at, 2)) == [(1, "v1")]
    assert stores.remove_replaced(spark, at, 2, 3600) == 0 and stores.remove_replaced(spark, at, 2, 0) == 2
    assert rows(stores.read_replaced(spark, at)) == [(3, "v3")] and rows(stores.read_replaced(spark, at, 3)) == [(2, "v2")]
