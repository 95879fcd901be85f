"""The bucketed cache against the lookup by plain joins; its table is read in place."""

import re

import pytest
from pyspark.sql import functions as F

from shotloom.operators import cache
from shotloom.operators.cache_table import CacheTable, second_chance


@pytest.fixture
def tables(spark):
    made = []

    def write(rows, kind="key string, valid boolean"):
        made.append(CacheTable.write(spark.createDataFrame(rows, kind), 4))
        return made[-1]

    yield write
    for t in made:
        t.drop()


def test_outcomes_equal_the_plain_lookup(spark, tables):
    now = [(f"n{i}", i % 4 != 0) for i in range(0, 300, 3)] + [(None, True)]
    old = [(f"o{i}", i % 10 != 0) for i in range(0, 300, 2)]
    asked = spark.createDataFrame([(i, f"n{i % 310}", f"o{i % 310}") for i in range(500)] + [(900, None, "o2"), (901, None, None), (902, "n3", None)], "pos int, key string, legacy_key string")
    frame = lambda rows: spark.createDataFrame([r for r in rows if r[0]], "key string, valid boolean")
    want = {r.pos: r.outcome for r in cache.lookup(asked, frame(now), frame(old)).collect()}
    got = second_chance(asked, tables(now), tables(old)).collect()
    assert len(got) == asked.count() and {r.pos: r.outcome for r in got} == want


def test_the_filter_rules_out_most_absent_keys_and_no_present_one(spark, tables):
    table = tables([(f"k{i}", True) for i in range(5000)])
    state = table.maybe(spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")).groupBy(F.col("id") < 5000, "may_hold").count().collect()
    counts = {(r[0], r.may_hold): r["count"] for r in state}
    assert counts[True, True] == 5000 and (True, False) not in counts
    assert counts.get((False, True), 0) < 15000 / 8
    assert tables([]).maybe(spark.createDataFrame([("a",), (None,)], "key string")).where("may_hold").count() == 0


def test_the_cache_side_isnt_moved(spark, tables):
    table = tables([(f"k{i}", True) for i in range(500)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table.get(spark.createDataFrame([("k1",), ("k2",), ("x",)], "key string"))
        assert {r.key for r in found.where("entry IS NOT NULL").collect()} == {"k1", "k2"}
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        scans = [m.start() for m in re.finditer(rf"FileScan parquet \S*{table.name}\[", plan)]
        assert scans
        for at in scans:
            above = plan[:at].rsplit("SortMergeJoin", 1)[1]
            assert not re.search(r"Exchange hashpartitioning\(ct_key", above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
