"""Quantile summaries against sorted lists."""

import bisect
import random
from collections import defaultdict

from pyspark.sql import functions as F

from shotloom.llm import quantile_summaries as Q


def test_ranks_are_exact_and_answers_near(spark):
    r = random.Random(4)
    rows = [("hot", i % 16, int(r.lognormvariate(10, 3)) - 5000) for i in range(40000)]
    rows += [("ties", i % 3, r.choice((5, 5, 9000))) for i in range(3000)] + [("one", 2, -7)] * 25 + [("few", 1, i) for i in range(19)] + [("just", 0, i * 5000) for i in range(20)]
    rows += [(None, 1, 1), ("few", None, 1), ("few", 1, None)]
    table = spark.createDataFrame([(*x, "extra") for x in rows], "grp string, batch int, x long, n string").repartition(7)
    got = Q.quantile_summaries(table, ["grp"]).collect()
    groups = defaultdict(list)
    for g, b, x in rows:
        if None not in (g, b, x):
            groups[g, b].append(x)
            groups[g, -1].append(x)
    want = {(*k, i) for k, v in groups.items() if len(v) >= 20 for i in range(1, 20)}
    assert {(x.grp, x.batch, x.i) for x in got} == want and len(got) == len(want)
    last = {}
    for x in sorted(got, key=lambda x: (x.grp, x.batch, x.i)):
        v = groups[x.grp, x.batch]
        v.sort()
        assert (x.n, x.target) == (len(v), -(-x.i * len(v) // 20))
        assert x.exact_x == v[x.target - 1] and x.answer in v
        assert (x.n_below, x.n_upto) == (bisect.bisect_left(v, x.answer), bisect.bisect_right(v, x.answer))
        assert x.rank_error == max(0, x.n_below + 1 - x.target, x.target - x.n_upto)
        assert x.within == (1000 * x.rank_error <= 10 * x.n) and x.within
        assert min(20, len(set(v))) <= x.points <= min(len(v), Q.MOST_POINTS)
        assert last.get((x.grp, x.batch), x.answer) <= x.answer
        last[x.grp, x.batch] = x.answer
        if len(v) <= Q.K:
            assert x.rank_error == 0


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], "grp string, batch int, x long")
    assert Q.quantile_summaries(empty, ["grp"]).collect() == []
    assert Q.quantile_summaries(spark.range(19).select(F.lit("a").alias("grp"), F.lit(0).alias("batch"), F.col("id").alias("x")), ["grp"]).count() == 0


def test_rows_without_money_or_group_are_left_out(spark):
    rows = [(1, 7, 1.005), (2, 7, None), (3, None, 1.0), (4, 7, float("nan")), (5, 7, float("inf")), (None, 7, -1.25)]
    got = Q.measured(spark.createDataFrame(rows, "id long, g long, m double"), 0, "g", "id", "m").collect()
    assert sorted((x.grp, x.batch, x.x - 1000 * x.batch) for x in got) == sorted([("7", 0, -125), ("7", [x.batch for x in got if x.x - 1000 * x.batch > 0][0], 100)])


def test_query_equals_plain_counts(spark):
    """The registered query's groups, counts and exact values against SQL."""
    import duckdb

    path = "/root/testdata/sf0.001"
    got = {(x.stream, x.grp, x.batch, x.i): (x.n, x.exact_x) for x in Q.op11_quantile_summaries(spark, path).collect()}
    sql = f"""
    WITH v AS (SELECT 'value' AS stream, client_id::VARCHAR AS grp, click_id AS id, value AS m FROM (SELECT DISTINCT click_id, client_id, value FROM '{path}/clicks.parquet') WHERE value IS NOT NULL AND client_id IS NOT NULL
      UNION ALL SELECT 'price', brand, vendor_id, price FROM '{path}/sale_lines.parquet' JOIN '{path}/items.parquet' USING (item_id) WHERE brand IS NOT NULL AND price IS NOT NULL)
    SELECT stream, grp, id::VARCHAR, m FROM v"""
    import math
    import zlib

    groups = defaultdict(list)
    for stream, grp, id_, m in duckdb.connect().execute(sql).fetchall():
        batch = zlib.crc32(id_.encode()) % 16
        for b in (batch, -1):
            groups[stream, grp, b].append(math.floor(100 * m + 0.5) + 1000 * batch)
    want = {(*k, i): (len(v), sorted(v)[-(-i * len(v) // 20) - 1]) for k, v in groups.items() if len(v) >= 20 for i in range(1, 20)}
    assert got == want
