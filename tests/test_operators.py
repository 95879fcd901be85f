"""Edges that the supplied tables don't reach."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from shotloom.functions import animation, numbers, style, text
from shotloom.operators import cache, ingest, intervals, manifest, retrieval, routing, stores, timeline

HIT = "vec_id long, ord int, modality string, shot_id string, media_id string, start_seconds double, end_seconds double, text string, score double, rank int"


def rows(df, *keys):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fusion_of_three_hits(spark):
    hits = spark.createDataFrame([(1, 0, "transcript", "shot-1", "media-1", 0.0, 4.0, "transcript evidence", 0.8, 1), (2, 0, "transcript", "shot-2", "media-1", 4.0, 8.0, "second evidence", 0.7, 2), (3, 1, "ocr", "shot-1", "media-1", 0.0, 4.0, "ocr evidence", 0.6, 1)], HIT)
    top = retrieval.top_shots(retrieval.fuse(hits), 8).collect()
    assert [r.shot_id for r in top] == ["shot-1", "shot-2"]
    assert top[0].score == pytest.approx(2 / 61) and top[1].score == pytest.approx(1 / 62)
    assert [e.modality for e in top[0].evidence] == ["transcript", "ocr"]
    assert (top[0].score_transcript, top[0].score_ocr) == (0.8, 0.6)


def test_negative_scores_malformed_hits_and_evidence_cap(spark):
    many = [(i, 0, "transcript", "s", "m", 1.0, 2.0, f"t{i}" + "x" * 300, -0.5, i) for i in range(1, 7)]
    top = retrieval.fuse(spark.createDataFrame([*many, (9, 1, "ocr", None, "m", 0.0, 1.0, "lost", 0.9, 1), (10, 1, "ocr", "", "m", 0.0, 1.0, "lost", 0.9, 2)], HIT)).collect()
    assert len(top) == 1 and len(top[0].evidence) == 4 and top[0].score_transcript == 0.0
    assert top[0].evidence[0].raw == -0.5 and len(top[0].evidence[0].snippet) == 280


def test_search_without_scope_or_modality_is_empty(spark):
    points = spark.createDataFrame([(1, 0, "transcript", "s", "m", 0.0, 1.0, "t", [1.0, 0.0])], "vec_id long, ord int, modality string, shot_id string, media_id string, start_seconds double, end_seconds double, text string, vector array<double>")
    assert retrieval.search(points, [1.0, 0.0], [], 8).count() == 0
    assert retrieval.search(points, [1.0, 0.0], ["m"], 8, ("visual",)).count() == 0
    assert retrieval.search(points, [1.0, 0.0], ["m"], 8).count() == 1
    with pytest.raises(ValueError):
        retrieval.search(points, [1.0, 0.0], ["m"], 51)
    assert retrieval.search_warnings(["visual", "visual"], []) == ["unsupported modality: visual", "no trusted media", "no searchable modality"]


def test_normalising_keeps_tiny_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([1e-13, 0.0],)], "v array<double>").select(retrieval.l2_normalize(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == [[0.6, 0.8], [1e-13, 0.0]]


def test_transcript_alignment(spark):
    segments = spark.createDataFrame([("m", 0, 0.0, 2.0, "first"), ("m", 1, 2.0, 4.0, "second"), ("m", 2, 6.0, 7.0, "late"), ("m", 3, 2.0, 2.0, "point")], "media_id string, pos long, start_seconds double, end_seconds double, text string")
    shots = spark.createDataFrame([("m", "a", 0.0, 3.0), ("m", "b", 3.0, 5.0), ("m", "c", 5.0, 6.0), ("m", "d", 2.0, 2.0)], "media_id string, shot_id string, start_seconds double, end_seconds double")
    for bucket in (1.0, 2.5, 1000.0):
        got = {r.shot_id: (r.text, r.segment_count) for r in intervals.align_transcript(shots, segments, bucket).collect()}
        assert got == {"a": ("first second", 2), "b": ("second", 1), "c": ("", 0), "d": ("", 0)}


def test_ocr_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, "LOW", 0.2), (1, 2, "Hello", 0.8), (1, 3, "World", 0.6), (2, 1, "x", 0.1), (3, 1, "edge", 0.3), (3, 2, "nan", math.nan), (3, 3, "none", None)], "frame_id long, pos long, text string, confidence double")
    got = {r.frame_id: r for r in ingest.ocr_by_frame(blocks, blocks.select("frame_id").distinct()).collect()}
    assert (got[1].text, got[1].block_count) == ("Hello World", 2) and got[1].mean_confidence == pytest.approx(0.7)
    assert (got[2].text, got[2].block_count, got[2].mean_confidence) == ("", 0, None)
    assert (got[3].text, got[3].block_count) == ("edge nan", 2)


def test_replacing_is_idempotent_and_clears(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "media_id string, v int")
    new = spark.createDataFrame([("a", 9)], "media_id string, v int")
    keys = spark.createDataFrame([("a",), ("b",)], "media_id string")
    once = stores.replace_by_key(base, new, keys, "media_id")
    assert rows(once) == rows(stores.replace_by_key(once, new, keys, "media_id")) == [("a", 9)]
    stores.write_replaced(once, str(tmp_path / "t"), "media_id")
    stores.write_replaced(once.limit(0).unionByName(base.where("media_id = 'b'")), str(tmp_path / "t"), "media_id")
    assert rows(stores.read_replaced(spark, str(tmp_path / "t")).select("media_id", "v")) == [("b", 2)]


def test_text_functions(spark):
    df = spark.createDataFrame([("A\r\nB\rC é",)], "t string")
    assert df.select(text.canonical_text(F.col("t"))).first()[0] == "A\nB\nC é"
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.cache_key(F.lit(":a:"), F.lit("b"))) == "a:b" and value(text.cache_key(F.lit("::"), F.lit("b"))) is None
    assert value(retrieval.snippet(F.lit("  a b\x1cc "))) == "a b c"
    assert value(text.safe_path(F.lit(""))) == "job" and value(text.safe_path(F.lit("é x/1"))) == "é_x_1"
    assert [value(text.seconds_literal(F.lit(x))) for x in ("4", "4s", "4.5 secs", "4m", "-1s", "4s\n")] == [4.0, 4.0, 4.5, None, None, None]
    assert value(text.format_seconds(F.lit(12.3456))) == "12.346s"
    import uuid

    assert value(text.point_key(F.lit("x:1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "shotloom:point:x:1"))
    assert value(numbers.round3(F.lit(2.0005))) == 2.001


def test_codec_states():
    import numpy as np

    good = cache.encode_vector(b"c" * 32, b"t" * 32, np.array([1.0, 2.0]))
    assert len(good) == 73 + 8
    read = lambda data, c=b"c" * 32, t=b"t" * 32, n=2: cache.decode_vector(data, c, t, n)
    assert read(good) == ("ok", [1.0, 2.0])
    assert [read(x)[0] for x in (None, b"", b"x" * 80, good[:-1])] == ["corrupt"] * 4
    assert read(good[:4] + b"\x02" + good[5:])[0] == "schema"
    assert read(good, c=b"d" * 32)[0] == "identity" and read(good, n=3)[0] == "dimension"
    assert read(cache.encode_vector(b"c" * 32, b"t" * 32, np.array([np.nan, 1])))[0] == "non-finite"


def test_stand_in_encoder_is_a_unit_vector(spark):
    v = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(cache.stand_in_encoder(F.col("t")).alias("v")).collect()
    assert v[0] == v[1] != v[2] and sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-5)


def test_keyframes(spark):
    track = F.from_json(F.lit('[{"time":2,"value":10},{"time":0,"value":0},{"time":4,"value":20,"easing":[0,0,1,1]}]'), "array<struct<time:double,value:double,easing:array<double>>>")
    at = lambda t: spark.range(1).select(animation.evaluate(track, F.lit(float(t)), F.lit(7.0))).first()[0]
    assert [at(-1), at(0), at(1), at(2), at(9)] == [0, 0, 5, 10, 20]
    assert at(3) == pytest.approx(10 + 10 * (3 * 0.5 * 0.25 * 1 + 0.125))
    empty = F.array().cast("array<struct<time:double,value:double,easing:array<double>>>")
    assert spark.range(1).select(animation.evaluate(empty, F.lit(1.0), F.lit(7.0))).first()[0] == 7.0


def test_style_of_a_half_blended_preset(spark):
    users = {k: F.lit(float(v)) for k, v in {"exposure": 12, "brightness": 115, "contrast": 90, "temperature": 14, "tint": -8, "saturation": 130, "vibrance": 120, "lift": 5, "gamma": -10, "gain": 7}.items()}
    a = style.adjusted(style.preset_of(F.lit("Cinematic"), F.lit(None).cast("string")), users, F.lit(50.0), F.lit(80.0))
    r = spark.range(1).select(a.alias("a")).select("a", style.filter_values(F.col("a")).alias("f")).first()
    assert tuple(r.a) == (10.4, 114.2, 97.2, 11.6, -7.2, 132.4, 124.0, 3.4, -6.8, 8.6)
    assert (r.f.brightness, r.f.contrast, r.f.saturation, r.f.hue_rotate) == (1.195958, 0.966322, 1.441602, -3.672)
    name = lambda b, t: spark.range(1).select(style.preset_of(F.lit(b), F.lit(t))).first()[0]
    assert [name("None", "Cool"), name("Odd", "Warm"), name("", ""), name("Noir", "Warm")] == ["Cold", "Original", "Original", "Noir"]


ITEM = "document_id long, track_index int, item_index int, item_id string, item_type string, timeline_start double, duration double, source_in double, source_out double, speed double, text string"


def plan_of(spark, command, selected=(), active=None, playhead=2.0):
    items = spark.createDataFrame([(1, 0, 0, "v1", "video", 0.0, 10.0, 0.0, 20.0, 1.0, None), (1, 0, 1, "v2", "video", 10.0, 5.0, 2.0, 7.0, 1.0, None), (1, 1, 0, "a1", "audio", 0.0, 8.0, 0.0, 8.0, 1.0, None), (1, 2, 0, "t1", "text", 1.0, 3.0, None, None, None, "Big Title")], ITEM)
    c = spark.createDataFrame([(1, 1, command, playhead, active, list(selected))], "command_id int, document_id long, command string, playhead double, active_id string, selected array<string>")
    return timeline.plan(c, items).first()


def test_planning(spark):
    p = lambda *a, **k: plan_of(spark, *a, **k)
    r = p("split here", active="v1")
    assert (r.ok, r.action, r.item_ids, r.start) == (True, "splitItem", "v1", 2.0)
    r = p("trim clip 1 from 1s to 4s")
    assert (r.action, r.start, r.duration, r.source_in, r.source_out) == ("trimItem", 1.0, 3.0, 1.0, 4.0)
    assert p("trim clip 2 from 1s to 2s").reason == "outside source"
    assert p("trim title from 1s to 2s").source_in is None
    assert p("trim clip 1 from a to 4s").reason == "invalid time"
    assert p("trim v2 to 2s").duration == 2.0
    assert p("DELETE", selected=["t1", "v1", "gone", "t1"]).item_ids == "t1,v1"
    assert p("delete").reason == "nothing selected" and p("delete big").item_ids == "t1"
    assert p("move v to 3s").reason == "ambiguous" and p("move zzz to 3s").reason == "no match"
    r = p("set volume to 25%", selected=["v1", "a1"])
    assert (r.item_ids, r.value) == ("a1", 0.25)
    assert p("set volume audio 1 to 101%").reason == "volume out of range"
    assert p("change speed clip 9 to 2x").reason == "no match" and p("change speed audio 1 to 2x").reason == "no match"
    assert p('add text "x"', playhead=1.25).start == 1.25
    assert p("  ").reason == "empty command" and p("fly").reason == "unsupported command"
    assert p("split v1 at 10s").reason == "split outside item"


def test_audio_ownership(spark):
    cols = "document_id long, track_id long, track_index int, track_kind string, hidden boolean, muted boolean, item_index int, item_id string, item_type string, item_muted boolean, linked_group string"
    items = spark.createDataFrame([
        (1, 1, 0, "video", False, False, 0, "v-owned", "video", False, "g1"), (1, 1, 0, "video", False, False, 1, "v-free", "video", False, None), (1, 1, 0, "video", False, False, 2, "v-hidden-owner", "video", False, "g2"),
        (1, 2, 1, "audio", False, True, 0, "a-muted-track", "audio", False, "g1"), (1, 3, 2, "audio", True, False, 0, "a-hidden", "audio", False, "g2"), (1, 4, 3, "video", False, True, 0, "v-muted-track", "video", False, None), (1, 5, 4, "audio", False, False, 0, "a", "audio", False, ""),
    ], cols)
    assert rows(manifest.audio_items(items).select("item_id", "source_owner")) == [("a", "audio-item"), ("v-free", "embedded-video"), ("v-hidden-owner", "embedded-video")]


def test_unsupported_states(spark):
    from shotloom.operators import export_rules

    cases = [
        ("video", "{}", None), ("video", '{"advanced":{"timeRemap":{"a":1}}}', "Time remapping"), ("image", '{"properties":{"adjust":{"clarity":{"value":3}}}}', "tonal detail controls"),
        ("text", '{"properties":{"animation":{"preset":"Pop"}}}', "an entrance or exit animation"), ("video", '{"properties":{"audioSettings":{"eq":"Bass"}}}', "advanced audio processing"),
        ("video", '{"properties":{"mask":{"maskSize":50}}}', None), ("audio", '{"properties":{"mask":{"maskSize":1}}}', None), ("video", '{"properties":{"mask":{"invert":true}}}', "a mask"),
        ("video", '{"advanced":{"color":{"rgbMatrix":[1,0,0,0,1]}}}', "Advanced state without keyframes"), ("video", '{"advanced":{"color":{"rgbMatrix":[1,0.5]}}}', "Color processing"),
        ("video", '{"advanced":{"color":{"hsl":{"red":{"hue":2}}}}}', "Color processing"), ("video", '{"advanced":{"color":{"curves":{"r":[{"x":0,"y":0},{"x":1,"y":0.9}]}}}}', "Color processing"),
        ("video", '{"advanced":{"opacity":{"keyframes":[{"time":0}]}}}', None), ("video", '{"advanced":{"opacity":{"keyframes":[]}}}', "Advanced state without keyframes"),
        ("text", '{"advanced":{"crop":{"top":{"keyframes":[1]}}}}', "Crop animation"), ("video", '{"advanced":{"transform":{"anchorX":{"keyframes":[1]}}}}', "Anchor animation"),
        ("image", '{"properties":{"filters":{"filterType":"Sparkle"}}}', "an unsupported filter"), ("image", '{"properties":{"filters":{"filterType":{"value":"Cool"}}}}', None),
        ("video", '{"properties":{"adjust":{"exposure":{"value":1,"keyframes":[{"time":0}]}}}}', "animated color or filter controls"), ("video", '{"properties":{"speedSettings":{"pitchCorrection":false}}}', "reverse, nonlinear speed, or pitch handling"),
        ("audio", '{"properties":{"eq":{"low":3}}}', "advanced audio processing"), ("audio", '{"properties":{"effects":{"echo":1}}}', "an item effect"), ("text", '{"style":{"animType":"Fade"}}', "an entrance or exit animation"), ("video", None, None),
    ]
    df = spark.createDataFrame([(i, t, j) for i, (t, j, _) in enumerate(cases)], "i int, t string, j string").select("i", export_rules.unsupported_state(F.col("j"), F.col("t")).alias("m"))
    assert {r.i: r.m for r in df.collect()} == {i: m for i, (_, _, m) in enumerate(cases)}
    docs = spark.createDataFrame([("{}",), ('{"transitions":[{}]}',), ('{"effects":[{"enabled":false}]}',), ('{"effects":[{"enabled":false},{}]}',)], "d string")
    assert [r.e for r in docs.select(export_rules.document_error(F.col("d")).alias("e")).collect()] == [None, "transitions", None, "effects"]


def test_breaker_and_its_stream(spark, tmp_path):
    calls = [("k", i, float(i), True) for i in range(5)] + [("k", 5, 6.0, False), ("k", 6, 14.0, True), ("k", 7, 15.0, False), ("k", 8, 25.0, False), ("k", 9, 26.0, True)]
    schema = "key string, seq long, t double, failed boolean"
    want = ["closed"] * 5 + ["open", "half-open", "open", "half-open", "closed"]
    got = routing.breaker_states(spark.createDataFrame(calls, schema)).orderBy("seq").collect()
    assert [r.state for r in got] == want
    from shotloom.streaming.pipelines import breaker_stream

    spark.createDataFrame(calls, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.state for r in spark.table("breaker").orderBy("seq").collect()] == want


def test_routing_stream_equals_batch(spark, tmp_path):
    from shotloom.streaming.pipelines import MESSAGE, due_retries, messages, route_stream

    ok = '{"mediaId":"m","kind":"Video"}'
    data = [(1, ok, None, False), (2, ok, "0", True), (3, ok, "2", True), (4, "{oops", None, False), (5, '{"mediaId":"m","kind":"Video","x":1}', None, False), (6, ok, "x", True)]
    df = spark.createDataFrame(data, MESSAGE)
    for i in range(2):
        df.where(F.col("event_id") % 2 == i).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    q = route_stream(messages(spark, str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    want = {r.event_id: r.route for r in routing.route(df).collect()}
    assert want == {1: "done", 2: "retry", 3: "failed", 4: "dead_letter", 5: "dead_letter", 6: "retry"}
    sink = lambda s: {r.event_id for r in spark.read.parquet(str(tmp_path / "out" / s)).collect()}
    assert (sink("completed"), sink("retry"), sink("dead_letter"), sink("events")) == ({1}, {2, 6}, {3, 4, 5}, {1, 3})
    due = due_retries(spark, str(tmp_path / "out"), F.lit(datetime.datetime(2999, 1, 1))).collect()
    assert {(r.event_id, r.attempt_header) for r in due} == {(2, "1"), (6, "1")}


def test_retry_headers(spark):
    h = routing.stamped_headers(F.create_map(F.lit("x-first-error"), F.lit("a"), F.lit("k"), F.lit("v")), F.lit(2), F.lit("b"))
    assert spark.range(1).select(h.alias("h")).first().h == {"x-first-error": "a", "k": "v", "x-attempt": "2", "x-last-error": "b"}


def test_files(spark, tmp_path):
    from shotloom.sources import files

    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    for name, data in (("a.png", png), ("b.png", png), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    found = files.objects(spark, str(tmp_path))
    sizes = {os.path.basename(r.path): (r.s.width, r.s.height) for r in found.select("path", files.image_size(F.col("content")).alias("s")).collect()}
    assert sizes == {"a.png": (7, 5), "b.png": (7, 5), "c.txt": (None, None)}
    assert sorted(r.n for r in found.groupBy("content_hash").agg(F.count("*").alias("n")).collect()) == [1, 2]
    assert files.objects(spark, str(tmp_path), "*.png", with_bytes=False).columns == ["path", "modificationTime", "length"]
    assert [spark.range(1).select(files.variant_height(F.lit(w), F.lit(h), 100)).first()[0] for w, h in ((200, 50), (100, 50), (10000, 1))] == [25, 50, 1]


def test_pixels_and_encoders(spark):
    import numpy as np
    from pyspark.sql import types as T

    from shotloom.functions import encoders, pixels

    rgba = np.array([[255, 0, 0, 128], [10, 20, 30, 255]], np.uint8)
    assert pixels.filtered(rgba, 1, 1, 1, 0, 0) is rgba
    grey = pixels.filtered(rgba, 1, 1, 0, 0, 0)
    assert grey[0].tolist() == [54, 54, 54, 128] and grey[1, 3] == 255
    assert pixels.filtered(rgba, 1, 1, 1, 360, 0)[1].tolist()[:3] == [10, 20, 30]
    one = spark.createDataFrame([(bytearray(rgba.tobytes()),)], "p binary").select(pixels.filter_pixels("p", *(F.lit(x) for x in (1.0, 1.0, 0.0, 0.0, 0.0))).alias("p")).first().p
    assert bytes(one) == grey.tobytes()
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    encode = encoders.batched_encoder(lambda: lambda xs: [[float(len(x)), 1.0] for x in xs], 2)
    assert [r.v for r in df.select(encode("t").alias("v")).collect()] == [[1.0, 1.0], [2.0, 1.0]]
    safe = encoders.best_effort(lambda x: 1 // (len(x) - 1), T.LongType())
    assert [(r.s.value, r.s.error) for r in df.select(safe("t").alias("s")).collect()] == [(None, "ZeroDivisionError: integer division or modulo by zero"), (1, None)]
    shots = encoders.one_to_many(lambda x: [(float(i),) for i in range(len(x))], "start double")
    assert rows(shots(df.withColumn("id", F.length("t")), "t")) == [(1, 0, 0.0), (2, 0, 0.0), (2, 1, 1.0)]
    with pytest.raises(RuntimeError):
        encoders.require_enabled(False, "retrieval")
