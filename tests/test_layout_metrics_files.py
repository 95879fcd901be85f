"""Text layout against a plain version, exposition of metrics, fingerprints of moving files, array helpers."""

import os
import random
import time

from pyspark.sql import functions as F

from shotloom.functions import arrays, colours, layout, text
from shotloom.operators import metrics
from shotloom.sources import fingerprints as P
from shotloom.streaming import observing

ADVANCES = {"i": 3.0, "m": 11.0, " ": 4.0, "é": 6.5}


def plain(value, width, default=7.0):
    size = lambda t: sum(ADVANCES.get(c, default) for c in t)
    lines = []
    for paragraph in (value or "").splitlines() or [""]:
        now = None
        for word in paragraph.split():
            pieces, own = [], ""
            for c in word:
                if own and size(own + c) > width:
                    pieces.append(own)
                    own = c
                else:
                    own += c
            pieces.append(own)
            if len(pieces) == 1 and now and size(now + " " + word) <= width:
                now += " " + word
                continue
            lines += ([now] if now else []) + pieces[:-1]
            now = pieces[-1]
        lines.append(now or "")
    return lines


def test_lines_of_a_text(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("imé abx") for _ in range(r.choice((1, 3, 6, 30))))
    texts = [r.choice((" ", "\n", "\t ")).join(word() for _ in range(r.randrange(8))) for _ in range(150)] + [None, "", "\n", "a\n", "\n\na", "a\r\nb\rc", "m" * 40, " m i ", "a b"]
    table = spark.createDataFrame([(t, float(w)) for t in texts for w in (5, 22, 60)], "t string, w double")
    advances = F.create_map(*(F.lit(x) for kv in ADVANCES.items() for x in kv))
    for row in table.select("t", "w", layout.wrapped(F.col("t"), advances, F.col("w"), 7.0).alias("lines"), layout.width_of(F.col("t"), advances, 7.0).alias("size")).collect():
        assert row.lines == plain(row.t, row.w), (row.t, row.w)
        assert row.size == (None if row.t is None else sum(ADVANCES.get(c, 7.0) for c in row.t))


def test_exposition_text(spark):
    samples = spark.createDataFrame([("ok", 'a"b\\c\nd', 3), ("bad", None, 1)], "outcome string, kind string, n long")
    assert metrics.exposed(metrics.exposition("jobs", "counter", samples, "Jobs by outcome")) == (
        '# HELP jobs_total Jobs by outcome\n# TYPE jobs_total counter\njobs_total{kind="",outcome="bad"} 1\njobs_total{kind="a\\"b\\\\c\\nd",outcome="ok"} 3\n'
    )
    sizes = spark.createDataFrame([("x", v) for v in (10, 100, 5000)], "kind string, v long")
    lines = metrics.histogram(sizes, "kind", F.col("v"), (64, 1024)).withColumn("total", F.lit(5110))
    assert metrics.exposed(metrics.exposition("bytes", "histogram", lines)) == (
        '# HELP bytes bytes\n# TYPE bytes histogram\nbytes_bucket{kind="x",le="64"} 1\nbytes_bucket{kind="x",le="1024"} 2\nbytes_bucket{kind="x",le="+Inf"} 3\nbytes_sum{kind="x"} 5110\nbytes_count{kind="x"} 3\n'
    )
    assert metrics.exposed(metrics.exposition("up", "gauge", spark.createDataFrame([(1,)], "n long"))) == "# HELP up up\n# TYPE up gauge\nup 1\n"


def test_counters_of_a_batch_and_a_stream(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") < 7, "hit").otherwise("miss").alias("outcome"))
    counters = observing.Counters()
    own = observing.outcomes("outcome", "hit", "miss", "corrupt")
    counters.observed(rows, "lookups", **own).write.format("noop").mode("overwrite").save()
    counters.collect()
    rows.write.parquet(str(tmp_path / "in"))
    spark.streams.addListener(counters)
    try:
        stream = counters.observed(spark.readStream.schema("id long, outcome string").parquet(str(tmp_path / "in")), "lookups", **own)
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        end = time.time() + 30
        while counters.values.get(("lookups", "hit")) != 14 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.text(spark, {"lookups": "Cache lookups"}) == (
        '# HELP lookups_total Cache lookups\n# TYPE lookups_total counter\nlookups_total{outcome="corrupt"} 0\nlookups_total{outcome="hit"} 14\nlookups_total{outcome="miss"} 6\n'
    )


def test_files_that_change_while_they_are_read(spark, tmp_path, monkeypatch):
    at = tmp_path / "f"
    at.mkdir()
    for name, content in (("a", b"same"), ("b", b"same"), ("c", b"once"), ("d", b"twice"), ("e", b"")):
        (at / name).write_bytes(content)
    real, calls = P.signatures, []

    def signatures(spark, path, pattern=None):
        calls.append(1)
        if len(calls) == 1:
            (at / "c").write_bytes(b"once more")
        if len(calls) <= 2:
            (at / "d").write_bytes(b"twice" * (1 + len(calls)))
            os.utime(at / "d", (time.time() + 10 * len(calls),) * 2)
        return real(spark, path, pattern)

    monkeypatch.setattr(P, "signatures", signatures)
    prints = P.fingerprints(spark, str(at))
    got = {r.path.rsplit("/", 1)[1]: r for r in prints.collect()}
    assert {k for k, r in got.items() if not r.stable} == {"d"} and set(got) == set("abcd")  # e is empty
    import hashlib

    assert got["c"].content_hash == hashlib.sha256(b"once more").hexdigest()
    uri = lambda n: got[n].path
    positions = spark.createDataFrame([(0, uri("b")), (1, uri("a")), (2, uri("d")), (3, uri("d")), (4, uri("c")), (5, "file:/none")], "pos int, path string")
    keyed = P.content_keys(positions, prints)
    groups = {r.first_pos: (r.representative, r.n) for r in P.content_groups(keyed).collect()}
    assert groups == {0: (uri("b"), 2), 2: (uri("d"), 2), 4: (uri("c"), 1)}
    assert P.expanded(keyed, P.content_groups(keyed)).where("n IS NOT NULL").count() == 5
    (at / "b").write_bytes(b"other")
    state = {r.content_key: r.unchanged for r in P.unchanged(keyed, prints, real(spark, str(at))).collect()}
    assert sorted(state.values()) == [False, True, True]


def test_array_helpers(spark):
    row = spark.range(1).select(
        arrays.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("uneven"),
        arrays.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(None).cast("int"))).alias("merged"),
        arrays.without_nulls(F.create_map(F.lit("a"), F.lit(None).cast("int"), F.lit("b"), F.lit(1))).alias("some"),
        text.parsed_iso(F.lit("2024-01-02T03:04:05Z")).alias("time"), text.parsed_iso(F.lit("2024-01-02T03:04:05")).alias("naive"), text.parsed_iso(F.lit("2024-13-02T03:04:05+01:00")).alias("bad"),
    ).first()
    assert row.uneven is None and row.merged == {"a": None, "b": 2} and row.some == {"b": 1}
    assert row.time.isoformat() == "2024-01-02T03:04:05" and row.naive is None and row.bad is None


def test_colours(spark):
    assert len(colours.NAMES) == 148 and all(len(v) == 6 and int(v, 16) >= 0 for v in colours.NAMES.values())
    want = {"#1af": (17, 170, 255, 255), "#1af8": (17, 170, 255, 136), "#010203": (1, 2, 3, 255), "#01020304": (1, 2, 3, 4), " Tomato ": (255, 99, 71, 255), "rgb(1, 20,300)": (1, 20, 255, 255), "rgba(1,2,3,4)": (1, 2, 3, 4), "#12": (255,) * 4, "no colour": (255,) * 4, "": (255,) * 4, None: (255,) * 4}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", colours.colour(F.col("t")).alias("c")).collect()
    assert {r.t: tuple(r.c) for r in rows} == want
