"""Exact rounding, canonical hashes, buckets, pointers, acknowledged retries, timeouts and names."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.functions import encoders, numbers, text
from shotloom.operators import cache, intervals, stores


def test_round3_is_correct_rounding(spark):
    r = random.Random(1)
    values = [1.0005, 8.1235, 2.6755, 0.0005, -2.6755, 2.5, -0.0004, 0.0, 1e15, 123456.7895, float("inf"), None]
    values += [round(r.uniform(-50, 50), 4) for _ in range(3000)] + [r.uniform(-1e6, 1e6) for _ in range(2000)] + [k / 2000 for k in range(-999, 999, 2)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.round3(F.col("v")).alias("r")).collect()
    assert all(x.r == (None if x.v is None else x.v if abs(x.v) == float("inf") else round(x.v, 3)) for x in rows)


def test_texts_equal_after_canonicalisation_are_one(spark):
    rows = [(1, "café\r\nx"), (2, unicodedata.normalize("NFD", "café") + "\nx"), (3, "plain\rx"), (4, "plain\nx"), (5, " \t")]
    got = cache.distinct_texts(spark.createDataFrame(rows, "pos long, text string")).collect()
    assert sorted((x.first_pos, x.n) for x in got) == [(1, 2), (3, 2)]


def test_bucket_follows_the_lengths(spark):
    shots = spark.createDataFrame([("m", i, 4.0 * i, 4.0 * i + 4) for i in range(100)], "media_id string, shot_id int, start_seconds double, end_seconds double")
    segments = spark.createDataFrame([("m", i, 1.5 * i, 1.5 * i + 2, f"t{i}") for i in range(200)], "media_id string, pos int, start_seconds double, end_seconds double, text string")
    assert intervals.bucket_of(shots, segments) == 4.0 and intervals.bucket_of(shots.limit(0)) == 1.0
    got = {x.shot_id: x.segment_count for x in intervals.align_transcript(shots, segments).collect()}
    assert got == {i: sum(max(4.0 * i, 1.5 * k) < min(4.0 * i + 4, 1.5 * k + 2) for k in range(200)) for i in range(100)}


def test_readers_see_the_last_whole_write(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in (1, 2, 3):
        stores.write_replaced(spark.createDataFrame([(n, "p")], "n int, k string"), path, "k")
        assert [x.n for x in stores.read_replaced(spark, path).collect()] == [n]
    assert stores.healthy(spark).collect()[0].ok == 1


def test_slow_calls_are_left_behind(spark):
    def tool(v):
        time.sleep(3 if v == 2 else 0)
        return v * 10

    got = spark.range(1, 4, 1, 1).select(encoders.best_effort(tool, T.LongType(), timeout=0.5)("id").alias("x")).select("x.*").collect()
    assert [x.value for x in got] == [10, None, 30] and got[1].error.startswith("TimeoutError")


@pytest.mark.parametrize(("name", "want"), [("top_k", "topK"), ("a", "a"), ("media_source_id", "mediaSourceId"), ("", "")])
def test_camel_case(spark, name, want):
    assert spark.range(1).select(text.camel_case(F.lit(name)).alias("x")).first().x == want


def test_padded_id(spark):
    row = spark.range(1).select(text.padded_id(F.lit("m"), F.lit(7)).alias("a"), text.padded_id(F.lit("m"), F.lit(123456)).alias("b")).first()
    assert tuple(row) == ("m:0007", "m:123456")


def test_acknowledged_retries_come_no_more(spark, tmp_path):
    from shotloom.streaming.pipelines import acknowledge, due_retries

    out = str(tmp_path)
    rows = spark.createDataFrame([("a", "{}", 1, True), ("b", "{}", 2, True)], "event_id string, value string, next_attempt int, handler_failed boolean")
    rows.withColumn("not_before", F.timestamp_seconds(F.lit(0))).write.parquet(f"{out}/retry/batch=0")
    due = due_retries(spark, out, F.current_timestamp())
    assert {x.event_id for x in due.collect()} == {"a", "b"}
    acknowledge(due.where("event_id = 'a'"), out)
    assert {x.event_id for x in due_retries(spark, out, F.current_timestamp()).collect()} == {"b"}
