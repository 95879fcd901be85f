"""Operators along an order against plain loops; one key holds most rows and is cut into several parts."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from shotloom.operators import ordered as O


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_and_carried_values_over_the_edges_of_parts(spark):
    r = random.Random(2)
    rows = [(r.choice(("hot",) * 6 + ("a", "b", None)), i, r.choice((None, i, i)), r.randrange(-5, 6)) for i in range(900)]
    parts = O.in_parts(spark.createDataFrame(rows, "k string, t int, v int, n long"), ["k"], ["t"])
    assert parts.where("k = 'hot'").select(O.PART).distinct().count() > 1
    out = O.running_sums(parts, ["k"], ["t"], total="n")
    out = O.carried(out, ["k"], ["t"], "v", "last")
    out = O.carried(out, ["k"], ["t"], "v", "before", this=False)
    out = O.carried(out, ["k"], ["t"], "v", "next", forward=False, this=False)
    got = {(x.k, x.t): (x.total, x["last"], x.before, x.next) for x in out.collect()}
    for key in ("hot", "a", "b", None):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: x[1])
        held = lambda xs: next((x[2] for x in xs if x[2] is not None), None)
        for i, x in enumerate(own):
            assert got[key, x[1]] == (sum(y[3] for y in own[: i + 1]), held(own[i::-1]), held(own[:i][::-1]), held(own[i + 1 :]))


@pytest.mark.parametrize("backward", [True, False])
def test_asof_join(spark, backward):
    r = random.Random(3)
    key = lambda: r.choice(("hot",) * 5 + ("a", None))
    left = [(key(), r.choice((None, *range(60))), i // 2) for i in range(400)]
    right = [(key(), r.choice((None, *range(60))), r.randrange(100)) for _ in range(150)]
    got = O.asof_join(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", backward)
    want = []
    for k, t, i in left:
        fit = [(u, v) for k2, u, v in right if k is not None and t is not None and k2 == k and u is not None and (u <= t if backward else u >= t)]
        want.append((k, t, i, (max(fit) if backward else min(fit)) if fit else None))
    rows = [(x.k, x.t, x.id, tuple(x.matched) if x.matched else None) for x in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "k string, t int, v int")
    assert O.asof_join(spark.createDataFrame(left, "k string, t int, id int"), empty, ["k"], "t").where("matched IS NOT NULL").count() == 0


def test_keyframes_as_rows_equal_the_track_of_one_row(spark):
    from shotloom.functions.animation import evaluate

    r = random.Random(4)
    frames = [(k, float(t), r.random(), r.choice((None, [0.25, 0.1, 0.25, 1.0]))) for k in range(6) for t in sorted(r.sample(range(20), r.randrange(0, 7)))]
    asked = [(k, t / 4) for k in range(7) for t in range(0, 90)]
    keyframes = spark.createDataFrame(frames, "track_id int, time double, value double, easing array<double>")
    queries = spark.createDataFrame(asked, "track_id int, time double")
    tracks = keyframes.groupBy("track_id").agg(F.collect_list(F.struct("time", "value", "easing")).alias("track"))
    want = queries.join(tracks, "track_id", "left").select("track_id", "time", evaluate(F.col("track"), F.col("time"), F.lit(None).cast("double")).alias("value"))
    key = lambda x: (x.track_id, x.time)
    for a, b in zip(sorted(O.keyframe_values(queries, keyframes).collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert key(a) == key(b) and (a.value == b.value or abs(a.value - b.value) < 1e-12)


def test_segments_cover_what_frames_do(spark):
    r = random.Random(5)
    items = [(r.choice(("hot", "hot", "b")), r.randrange(4), r.randrange(400) / 7, r.choice((0.0, 0.1, 2.5, 30.0))) for _ in range(200)] + [("c", 1, None, 1.0), ("c", 1, 3.0, None)]
    got = O.active_segments(spark.createDataFrame(items, "document_id string, track_index int, timeline_start double, duration double"), 24).collect()
    import math

    want = {}
    for doc, track, start, length in items:
        if start is not None and length is not None:
            for f in range(math.ceil(start * 24), math.ceil((start + length) * 24)):
                n, w = want.get((doc, f), (0, 0))
                want[doc, f] = (n + 1, w + track)
    assert {(x.document_id, f): (x.layers, x.weight_sum) for x in got for f in range(x.from_frame, x.to_frame + 1)} == want
    assert len(got) <= 2 * len(items) and sum(x.to_frame - x.from_frame + 1 for x in got) == len(want)


def test_shot_cuts_keep_the_least_length(spark):
    r = random.Random(6)
    frames, state = [], {}
    for i in range(1500):
        m = r.choice(("hot", "hot", "hot", "b"))
        if r.random() < 0.2:
            state[m] = [r.random(), r.random(), r.random()]
        frames.append((m, i, state.setdefault(m, [1.0, 0.0, 0.0])))
    frames += [("b", 5000, None), (None, 5001, [1.0, 0.0, 0.0]), ("alone", 1, [1.0, 1.0, 1.0])]
    got = sorted((x.media_id, x.frame) for x in O.shot_cuts(spark.createDataFrame(frames, "media_id string, frame int, vector array<double>"), 0.05, 12).collect())
    want = []
    for m in ("hot", "b"):
        own = [(i, v) for k, i, v in frames if k == m and v]
        last = own[0][0]
        for (_, a), (i, b) in zip(own, own[1:], strict=False):
            dot = sum(x * y for x, y in zip(a, b, strict=True))
            d = 1 - dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
            if d >= 0.05 and i - last >= 12:
                want.append((m, i))
                last = i
    assert got == sorted(want) and bisect.bisect(got, ("b", 0)) == 0


def test_breaker_runs_equal_one_fold_of_each_key(spark):
    from shotloom.operators.routing import FAILURES, OPEN_SECONDS, breaker_states

    r = random.Random(7)
    calls, now = [], 0.0
    for i in range(1500):
        now += r.choice((0.1, 0.5, 1.0, 12.0, -3.0))
        calls.append((r.choice(("hot", "hot", "hot", "b", None)), i, None if r.random() < 0.02 else now, None if r.random() < 0.02 else r.random() < 0.6))
    got = {x.seq: (x.state, x.allowed) for x in breaker_states(spark.createDataFrame(calls, "key string, seq long, t double, failed boolean")).collect()}
    state = {}
    for k, seq, t, failed in calls:
        fails, opened, is_open = state.get(k, (0, None, False))
        if is_open and opened is not None and t is not None and t < opened + OPEN_SECONDS:
            assert got[seq] == ("open", False)
            continue
        assert got[seq] == ("half-open" if is_open else "closed", True)
        again = fails + 1 if failed else 0
        state[k] = (again, t, True) if failed and (is_open or again >= FAILURES) else (again, None, False)
    assert len(got) == len(calls)
