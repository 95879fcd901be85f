"""Findings of round three: repeated updates of a key, sizes of tasks and of shuffles."""

from pyspark.sql import functions as F

from shotloom.operators import ordered, stores, timeline
from shotloom.sources import adapters as A


def test_upsert_takes_one_row_of_repeated_updates(spark):
    base = spark.createDataFrame([(1, 1.0, "base"), (2, 2.0, "base"), (3, None, "base")], "k long, v double, source string")
    new = spark.createDataFrame([(2, None, "update"), (2, 5.0, "update"), (2, 4.0, "update"), (4, None, "update"), (4, None, "update")], "k long, v double, source string")
    want = [(1, 1.0, "base"), (2, 5.0, "update"), (3, None, "base"), (4, None, "update")]
    for n in (1, 3):
        assert sorted(map(tuple, stores.upsert(base, new.repartition(n), "k").collect())) == want
    assert sorted(r.k for r in stores.upsert(base.select("k"), new.select("k"), "k").collect()) == [1, 2, 3, 4]
    assert stores.upsert(base, new.limit(0), "k").count() == 3


def _timeline(spark, documents):
    kinds = F.element_at(F.array(*map(F.lit, ("video", "audio", "text", "image"))), (F.col("item_index") % 4 + 1).cast("int"))
    rows = spark.range(documents * 12).select((F.col("id") % documents).alias("document_id"), F.lit(0).alias("track_index"), F.floor(F.col("id") / documents).cast("int").alias("item_index"))
    rows = rows.withColumns({"item_id": F.concat(F.lit("Item-"), "item_index"), "item_type": kinds, "timeline_start": F.col("item_index") * 1.0, "duration": F.lit(2.0), "source_in": F.lit(0.0), "source_out": F.lit(9.0), "speed": F.lit(1.0)})
    return rows.withColumn("text", F.concat(F.lit("Title "), "item_index"))


def _asked(spark, commands):
    rows = [(i, *c) for i, c in enumerate(commands)]
    return spark.createDataFrame(rows, "command_id long, document_id long, command string, playhead double, active_id string, selected array<string>")


def test_plan_deals_items_once(spark):
    items = _timeline(spark, 3)
    out = timeline.plan(_asked(spark, [(d, "move clip 2 to 4.5s", 0.0, None, []) for d in (0, 1, 2, 7)]), items, 3)
    assert [(r.command_id, r.item_ids, r.reason) for r in out.orderBy("command_id").collect()] == [(0, "Item-4", None), (1, "Item-4", None), (2, "Item-4", None), (3, None, "no match")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_plan_deals_items_once_for_parts_of_texts(spark):
    own = F.when(F.col("item_index") == 5, "Clip 1").when(F.col("item_index") == 6, "tle 7").otherwise(F.col("item_id"))
    items = _timeline(spark, 2).withColumn("item_id", F.when(F.col("document_id") == 1, own).otherwise(F.col("item_id")))
    commands = {
        (0, "delete tle 7"): "Item-7", (0, "delete tle 1"): "ambiguous", (0, "delete clip 1"): "Item-0", (0, "delete nothing-like-this"): "no match", (1, "delete tle 7"): "tle 7", (1, "change speed tle 7 to 2x"): "no match",
        (1, "delete clip 1"): "Clip 1", (1, "set volume clip 1 to 5%"): "Clip 1", (1, "change speed clip 1 to 2x"): "Item-0", (1, "delete lip"): "Clip 1", (7, "delete tle 7"): "no match",
    }
    out = timeline.plan(_asked(spark, [(d, c, 1.0, None, []) for d, c in commands]), items, 3)
    assert [r.item_ids if r.ok else r.reason for r in out.orderBy("command_id").collect()] == list(commands.values())
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_plan_matches_in_stages_and_kinds(spark):
    commands = {
        (0, "delete ITEM-3", None): "Item-3", (0, "delete title 1", None): "ambiguous", (0, "delete tle 7", None): "Item-7", (0, "delete item 02", None): "Item-1", (0, "set volume item 2 to 5%", None): "Item-5",
        (0, "set volume clip 1 to 5%", None): "no match", (0, "set volume to 5%", ("Item-0", "Item-1", "Item-2")): "Item-1", (0, "change speed item-1 to 2x", None): "no match", (0, "set volume tle 1 to 5%", None): "Item-1",
        (0, "delete", ("Item-9", "gone", None, "Item-1", "Item-9")): "Item-9,Item-1", (0, "delete", ("gone",)): "nothing selected", (None, "delete item 1", None): "no match", (5, "delete item 1", None): "no match", (0, 'add text "x"', None): None,
        (0, "change speed to 2x", ("Item-0", "Item-4")): "ambiguous", (0, "delete item 99999999999", None): "no match", (None, "", None): "empty command",
    }
    asked = _asked(spark, [(d, c, 1.0, None, list(s) if s else s) for d, c, s in commands])
    items = _timeline(spark, 2).unionByName(_timeline(spark, 1).withColumns({"document_id": F.lit(None).cast("long")}))
    for parts in (None, 5):
        got = timeline.plan(asked, items, parts).orderBy("command_id").collect()
        assert [r.item_ids if r.ok else r.reason for r in got] == list(commands.values())


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 100)
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(0)).otherwise(F.col("id")).alias("k"), "id", (F.col("id") % 7).alias("v"))
    parts = ordered.in_parts(rows, ["k"], ["id"])
    assert parts.groupBy(ordered.PART).count().agg(F.max("count")).first()[0] < 300
    sums = ordered.running_sums(parts, ["k"], ["id"], total="v")
    assert sums.rdd.getNumPartitions() == 30
    assert sums.where("k = 0").agg(F.max(F.struct("id", "total"))["total"]).first()[0] == sum(i % 7 for i in range(1500))
    assert sums.where("k > 0 AND total <> v").count() == 0


def test_keyframes_over_the_edges_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 50)
    keyframes = spark.range(0, 2000, 400).select(F.lit("t").alias("track_id"), F.col("id").cast("double").alias("time"), (F.col("id") * 2.0).alias("value"), F.lit(None).cast("array<double>").alias("easing"))
    queries = spark.range(2000).select(F.lit("t").alias("track_id"), F.col("id").cast("double").alias("time"))
    got = {r.time: round(r.value, 9) for r in ordered.keyframe_values(queries, keyframes).collect()}
    assert got == {float(t): min(t, 1600) * 2.0 for t in range(2000)}


def test_tasks_over_line_items_follow_the_rows(spark, monkeypatch):
    path = "/root/testdata/sf0.01"
    want = sorted(map(tuple, A.load(spark, path, A.ITEMS).select("item_id", "document_id").collect()))
    monkeypatch.setattr(A, "TASK_ROWS", 2000)
    items = A.load(spark, path, A.ITEMS).select("item_id", "document_id")
    assert sorted(map(tuple, items.collect())) == want
    n = -(-spark.read.parquet(f"{path}/lineitem.parquet").count() // 2000)
    assert "REPARTITION_BY_NUM" in (plan := items._jdf.queryExecution().executedPlan().toString()) and f", {n})" in plan
