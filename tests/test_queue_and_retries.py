"""The queue source loses nothing when handlers die; delayed retries come once, when due, also after a restart."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from shotloom.operators.routing import route
from shotloom.streaming import queue, retries


def test_messages_come_again_until_their_batch_is_done(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = spark.range(1000).select(F.col("id").alias("key"), F.concat(F.lit("m\n é"), "id").alias("value"))
    queue.publish(rows.where("id < 400"), path, partitions=4)
    queue.publish(rows.where("id >= 400"), path, partitions=4)
    queue.publish(rows.limit(0), path, partitions=4)
    seen, sizes, died = collections.Counter(), [], []

    def handle(batch, batch_id):
        values = [r.value for r in batch.collect()]
        seen.update(values)
        sizes.append(len(values))
        if batch_id == 2 and not died:
            died.append(batch_id)
            raise RuntimeError("handler died")

    def start():
        return queue.consume(spark, path, prefetch=60).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c")).start()

    q = start()
    with pytest.raises(Exception, match="handler died"):
        q.processAllAvailable()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert set(seen) == {f"m\n é{i}" for i in range(1000)} and died
    assert 0 < sum(seen.values()) - 1000 <= 240 and max(sizes) <= 240
    queue.publish(rows.where("id < 5"), path, partitions=4)
    before = sum(seen.values())
    q = start()  # after a clean stop only what is new comes
    q.processAllAvailable()
    q.stop()
    assert sum(seen.values()) == before + 5


def test_retries_come_once_when_due_also_after_a_restart(spark, tmp_path):
    for k, v in retries.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        kind = "event_id long, value string, attempt_header string, handler_failed boolean"
        message = lambda n, kind="Video": (n, f'{{"mediaId":"m{n}","kind":"{kind}"}}', None, True)
        spark.createDataFrame([message(i) for i in range(20)] + [message(3), message(99, "Poem")], kind).coalesce(1).write.mode("append").json(source)

        def start():
            failed = route(spark.readStream.schema(kind).json(source)).where("route = 'retry'").withColumn("delay_seconds", F.when(F.col("event_id") < 10, 1).otherwise(14))
            return retries.delayed(failed).withColumn("at", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

        def got():
            return collections.Counter((r.event_id, r.attempt_header) for r in spark.read.schema("event_id long, attempt_header string").parquet(out).collect())

        began = time.time()
        q = start()
        while len(got() if (tmp_path / "out" / "_spark_metadata").exists() else ()) < 10 and time.time() - began < 90 and q.isActive:
            time.sleep(1)
        assert q.exception() is None
        q.stop()
        early = got()
        assert set(early.values()) == {1} and set(range(10)) <= {k for k, _ in early}
        q = start()
        while len(got()) < 20 and time.time() - began < 150 and q.isActive:
            time.sleep(1)
        time.sleep(2)
        assert q.exception() is None
        q.stop()
        assert got() == {(i, "1"): 1 for i in range(20)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
