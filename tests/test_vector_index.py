"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import vector_index as I
from shotloom.sources import adapters as A

PATH = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def points(spark):
    return A.load(spark, PATH, A.POINTS).cache()


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    return I.build(points, str(tmp_path_factory.mktemp("index") / "v"), 16)


@pytest.fixture(scope="module")
def exact(points):
    rows = points.select("vec_id", "vector").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows])
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return ids, x


def best(exact, i, k):
    ids, x = exact
    s = x @ x[i]
    order = np.lexsort((ids, -s))[:k]
    return ids[order], s[order]


def test_every_vector_is_in_one_cell(spark, index, points):
    table = index.table(spark)
    assert table.count() == points.count() == index.rows.sum() and table.select("vec_id").distinct().count() == points.count()
    again = I.load(spark, index.path)
    assert np.array_equal(again.centres, index.centres) and np.array_equal(again.rows, index.rows)


def test_all_cells_give_the_exact_result_and_few_cells_nearly(spark, index, exact):
    ids, x = exact
    queries = spark.createDataFrame([(int(ids[i]), [float(v) for v in x[i]]) for i in range(0, len(ids), 20)], "query_id long, vector array<double>")
    want = {int(ids[i]): list(best(exact, i, 10)[0]) for i in range(0, len(ids), 20)}
    for probes, least in ((16, 1.0), (12, 0.9)):
        got = {}
        for r in I.search_many(index, queries, 10, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        recall = np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()])
        assert recall >= least, (probes, recall)


def test_bounds_make_pruned_search_exact(spark, index, exact):
    ids, x = exact
    for i in (3, 77, 200):
        q = [float(v) for v in x[i]]
        got = I.search_exact(index, spark, q, 5, probes=2).orderBy("rank").collect()
        assert [r.vec_id for r in got] == list(best(exact, i, 5)[0])
        cosine = index.best_cosine(q)
        rows = index.table(spark).where("vec_id % 3 = 0").select("vec_id", "cell").collect()
        at = {int(v): k for k, v in enumerate(ids)}
        assert all(x[at[r.vec_id]] @ x[i] <= cosine[r.cell] for r in rows)


def test_only_the_probed_partitions_are_read(spark, index, exact):
    q = [float(v) for v in exact[1][5]]
    df = I.search(index, spark, q, 3, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert df.select("cell").distinct().count() <= 2


def test_scope_nulls_ties_and_empty_tables(spark, tmp_path):
    rows = [(i, [1.0, 0.0], "a") for i in range(30)] + [(30, None, "a"), (31, [], "a"), (32, [0.0, 0.0], "a"), (33, [1.0, 2.0, 3.0], "b"), (34, [0.0, 2.0], "b")]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>, media_id string")
    index = I.build(table, str(tmp_path / "a"), 4)
    assert index.rows.sum() == 31
    got = I.search(index, spark, [2.0, 0.1], 3, 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2]
    got = I.search_exact(index, spark, [2.0, 0.1], 3, 1, F.col("media_id") == "b").collect()
    assert [r.vec_id for r in got] == [34]
    none = I.build(table.limit(0), str(tmp_path / "b"), 4)
    assert len(none.centres) == 0 and len(none.nearest_cells([1.0])) == 0
