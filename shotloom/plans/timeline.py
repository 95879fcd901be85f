"""Timeline, planning and manifest queries over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import animation as N
from ..functions import numbers as U
from ..functions import style as Y
from ..operators import intervals as V
from ..operators import manifest as M
from ..operators import timeline as P
from ..sources import adapters as A
from ..workspace import written
from .register import exact, query

_ITEMS = f"WITH i AS ({A.ITEMS})"
_USED = _ITEMS + ", u AS (SELECT * FROM i WHERE NOT hidden AND NOT (track_kind = 'audio' AND muted) AND NOT (item_type = 'audio' AND item_muted))"
_OWNERS = "(SELECT DISTINCT document_id, linked_group FROM i WHERE NOT hidden AND item_type = 'audio' AND linked_group <> '')"
_AUDIO = _USED + f""", a AS (SELECT u.*, 'audio-item' AS source_owner FROM u WHERE item_type = 'audio' UNION ALL SELECT u.*, 'embedded-video' FROM u WHERE item_type = 'video' AND NOT muted
 AND NOT EXISTS (SELECT 1 FROM {_OWNERS} o WHERE o.document_id = u.document_id AND o.linked_group = u.linked_group))"""


def _items(spark, d):
    return A.load(spark, d, A.ITEMS)


def _planned_items(spark, d):
    """The items, written, as choosing and planning read them several times, and their parts."""
    items = written(_items(spark, d).select("document_id", "track_index", "item_index", "item_id", "item_type", "layer_order", "timeline_start", "duration", "source_in", "source_out", "speed", "text"), "plan_items")
    return items, P.parts_of(items)


@query("wn_stack_order", _ITEMS + """ SELECT document_id, item_id, max(n) AS stack_order FROM (SELECT document_id, item_id, row_number() OVER (PARTITION BY document_id ORDER BY phase, CASE WHEN phase = 0 THEN -track_index ELSE layer_order END, CASE WHEN phase = 0 THEN layer_order ELSE track_index END, item_index, item_id) - 1 AS n
 FROM (SELECT *, CASE WHEN track_kind = 'video' AND item_type IN ('video', 'image') THEN 0 ELSE 1 END AS phase FROM i WHERE NOT hidden AND item_type <> 'audio')) GROUP BY document_id, item_id""")  # fmt: skip
def stack_order(spark, d):
    return M.stack_order(_items(spark, d)).withColumn("stack_order", F.col("stack_order").cast("long"))


@query("wn_upgraded_stack", _ITEMS + " SELECT document_id, item_id, row_number() OVER (PARTITION BY document_id ORDER BY timeline_start, layer_order, item_id, CAST(item_type = 'text' AS INT), track_index, item_index) - 1 AS stack_order FROM i WHERE item_type <> 'audio'")
def upgraded_stack(spark, d):
    return M.upgraded_stack_order(_items(spark, d)).withColumn("stack_order", F.col("stack_order").cast("long"))


@query("fl_usable_items", _USED + " SELECT document_id, item_id, item_type FROM u")
def usable(spark, d):
    return M.usable_items(_items(spark, d)).select("document_id", "item_id", "item_type")


@query("jn_audio_ownership", _AUDIO + " SELECT document_id, item_id, source_owner, timeline_start, track_index FROM a")
def ownership(spark, d):
    return M.audio_items(_items(spark, d)).select("document_id", "item_id", "source_owner", "timeline_start", "track_index")


@query("ag_manifest_duration", exact(_USED + " SELECT document_id, round(greatest(0.1, max(timeline_start + duration)), 3) AS duration_seconds FROM u GROUP BY document_id", 3))
def manifest_duration(spark, d):
    return M.durations(M.usable_items(_items(spark, d)))


@query("jn_media_sources", _USED + f""", m AS ({A.MEDIA}) SELECT u.item_id, CASE WHEN m.media_id IS NULL THEN 'unresolved media' WHEN trim(m.object_key) = '' THEN 'missing key' WHEN u.item_type <> 'audio' AND (m.width <= 0 OR m.height <= 0) THEN 'missing dimensions' END AS error,
 coalesce(nullif(m.name, ''), 'canonical.mp4') AS name, CASE WHEN m.kind = 'Video' THEN 'video' WHEN m.kind = '1' THEN 'audio' WHEN m.kind = 'x.image' THEN 'image' END AS kind
 FROM u LEFT JOIN m ON m.media_id = u.media_id WHERE u.item_type <> 'text'""".replace("coalesce(nullif(m.name, ''), 'canonical.mp4')", "CASE WHEN m.media_id IS NULL THEN u.media_id ELSE coalesce(nullif(m.name, ''), 'canonical.mp4') END"))  # fmt: skip
def media_sources(spark, d):
    both = M.with_media(M.usable_items(_items(spark, d)), A.load(spark, d, A.MEDIA))
    return both.select("item_id", "error", M.display_name(F.col("name"), F.col("object_key"), F.col("media_id")).alias("name"), M.media_kind(F.col("kind")).alias("kind"))


@query("fl_first_error", _USED + f", m AS ({A.MEDIA}) SELECT document_id, arg_min(u.item_id, u.track_index * 1000000 + u.item_index) AS item_id FROM u LEFT JOIN m ON m.media_id = u.media_id WHERE u.item_type <> 'text' AND (m.media_id IS NULL OR (u.item_type <> 'audio' AND (m.width <= 0 OR m.height <= 0))) GROUP BY document_id")
def first_error(spark, d):
    both = M.with_media(M.usable_items(_items(spark, d)), A.load(spark, d, A.MEDIA))
    return M.first_error(both, F.col("error")).select("document_id", "item_id")


_VISUAL = _USED + ", v AS (SELECT * FROM u WHERE item_type IN ('video', 'image', 'overlay'))"


@query("jn_active_frames", _VISUAL + " SELECT document_id, frame, count(*) AS layers, sum(track_index)::BIGINT AS track_sum FROM (SELECT document_id, track_index, unnest(range(CAST(ceil(timeline_start * 2) AS BIGINT), CAST(ceil((timeline_start + duration) * 2) AS BIGINT))) AS frame FROM v) GROUP BY document_id, frame")
def active_frames(spark, d):
    visual = M.usable_items(_items(spark, d)).where(F.col("item_type").isin(*M.VISUAL_TYPES))
    return V.frames_of(visual, 2).groupBy("document_id", "frame").agg(F.count("*").alias("layers"), F.sum("track_index").alias("track_sum"))


_TRACK = "[{{'time': 0.5, 'value': 0.0, 'easing': NULL}}, {{'time': 2.0, 'value': 1.0, 'easing': [0.25, 0.1, 0.25, 1.0]}}, {{'time': 4.0, 'value': 0.25, 'easing': NULL}}]"


@query("jn_keyframe_bracket", _ITEMS + """ SELECT item_id, round(CASE WHEN t <= 0.5 THEN 0 WHEN t >= 4 THEN 0.25 WHEN t <= 2 THEN 3 * (1 - p) * (1 - p) * p * 0.1 + 3 * (1 - p) * p * p * 1.0 + p * p * p ELSE 1 + (0.25 - 1) * ((t - 2) / 2) END, 9) AS value FROM (SELECT item_id, duration / 3 AS t, (duration / 3 - 0.5) / 1.5 AS p FROM i)""")
def keyframe_bracket(spark, d):
    kind = T.ArrayType(T.StructType.fromDDL("time DOUBLE, value DOUBLE, easing ARRAY<DOUBLE>"))
    track = F.from_json(F.lit('[{"time":4.0,"value":0.25},{"time":0.5,"value":0.0},{"time":2.0,"value":1.0,"easing":[0.25,0.1,0.25,1.0]}]'), kind)
    return _items(spark, d).select("item_id", F.round(N.evaluate(track, F.col("duration") / 3, F.lit(9.0)), 9).alias("value"))


@query("sf_faded_opacity", _ITEMS + """ SELECT item_id, round(greatest(0, least(1, (1 - opacity_drop) * CASE WHEN fi > 0 THEN least(1, t / fi) ELSE 1 END * CASE WHEN fo > 0 AND t > duration - fo THEN greatest(0, (duration - t) / greatest(fo, 0.001)) ELSE 1 END)), 9) AS opacity
 FROM (SELECT *, duration * 0.9 AS t, least(fade_in, duration) AS fi, least(fade_out, duration) AS fo FROM i)""")  # fmt: skip
def opacity(spark, d):
    c = F.col
    return _items(spark, d).select("item_id", F.round(N.faded_opacity(1 - c("opacity_drop"), c("duration") * 0.9, c("duration"), c("fade_in"), c("fade_out")), 9).alias("opacity"))


@query("sf_source_range", exact(_ITEMS + """ SELECT item_id, CASE WHEN ok AND media THEN a END AS source_in, CASE WHEN ok AND media THEN b END AS source_out, ok OR NOT media AS ok FROM (SELECT *, a >= source_in AND b <= source_out AND b > a AS ok FROM (SELECT *, round(a + 1.0 * speed, 3) AS b FROM (SELECT *, item_type IN ('video', 'audio') AS media, round(source_in + 0.5 * speed, 3) AS a FROM i)))""", 3))
def source_range(spark, d):
    c = F.col
    r = U.source_range(c("item_type"), c("source_in"), c("source_out"), c("speed"), c("timeline_start"), c("timeline_start") + 0.5, F.lit(1.0))
    return _items(spark, d).select("item_id", r.alias("r")).select("item_id", "r.*")


@query("sf_audio_duration", _AUDIO + " SELECT item_id, source_owner, round(least(duration, greatest(0.001, (source_out - source_in) / speed)), 9) AS seconds, CAST(round(timeline_start * 1000) AS BIGINT) AS delay_ms FROM a")
def audio_duration(spark, d):
    c = F.col
    return M.audio_items(_items(spark, d)).select("item_id", "source_owner", F.round(M.audio_seconds(c("duration"), c("source_in"), c("source_out"), c("speed")), 9).alias("seconds"), F.round(c("timeline_start") * 1000).cast("long").alias("delay_ms"))


@query("sf_frame_count", _ITEMS + " SELECT item_id, greatest(1, CAST(ceil(greatest(0.1, duration) * 24) AS BIGINT)) AS frames FROM i")
def frame_count(spark, d):
    return _items(spark, d).select("item_id", U.frame_count(F.col("duration"), 24).alias("frames"))


@query("so_manifest_order", _AUDIO + " SELECT document_id, item_id, row_number() OVER (PARTITION BY document_id ORDER BY timeline_start, track_index, item_id, item_index) AS pos FROM a")
def manifest_order(spark, d):
    return M.in_audio_order(M.audio_items(_items(spark, d))).select("document_id", "item_id", "pos")


@query("wn_ordinal_items", _ITEMS + " SELECT document_id, item_type, item_id, row_number() OVER (PARTITION BY document_id, item_type ORDER BY track_index, item_index) AS ordinal FROM i")
def ordinals(spark, d):
    return P.ordinals(_items(spark, d), "document_id", "item_type").select("document_id", "item_type", "item_id", "ordinal")


@query("jn_selection_order", _ITEMS + ", s AS (SELECT document_id, list(item_id ORDER BY item_index DESC, track_index, item_id) AS ids FROM i WHERE layer_order = 3 GROUP BY document_id), x AS (SELECT document_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) - 1 AS pos FROM s) SELECT x.document_id, x.pos::INT AS pos, x.item_id FROM x WHERE EXISTS (SELECT 1 FROM i WHERE i.document_id = x.document_id AND i.item_id = x.item_id AND NOT i.hidden)")
def selection_order(spark, d):
    items = _items(spark, d)
    order = F.struct((-F.col("item_index")).alias("n"), "track_index", "item_id")
    chosen = items.where("layer_order = 3").groupBy("document_id").agg(F.sort_array(F.collect_list(order))["item_id"].alias("ids"))
    return P.selected_items(chosen, items.where(~F.col("hidden")))


@query("sf_style_values", exact(f"""SELECT p_partkey, round(least(200, greatest(0, 100 + (p_size - 25) + (118 - 100) * share)), 6) AS contrast, round(least(100, greatest(-100, p_size + (-6) * share)), 6) AS temperature, round(least(100, greatest(-100, 8 * share)), 6) AS gamma, round(least(100, greatest(-100, 4 * share)), 6) AS gain,
 round(least(3, greatest(0.08, round(least(200, greatest(0, 100 + (p_size - 25) + (118 - 100) * share)), 6) / 100 + round(8 * share, 6) / 260 + round(4 * share, 6) / 420)), 6) AS filter_contrast FROM (SELECT *, (least(100, p_retailprice / 20) / 100) * 0.8 AS share FROM part)""", 6))  # fmt: skip
def style_values(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    a = Y.adjusted(F.lit("Cinematic"), {"contrast": F.col("p_size") + 75.0, "temperature": F.col("p_size") + 0.0}, F.col("p_retailprice") / 20, F.lit(80.0))
    rows = rows.select("p_partkey", a.alias("a"))
    return rows.select("p_partkey", "a.contrast", "a.temperature", "a.gamma", "a.gain", Y.filter_values(F.col("a"))["contrast"].alias("filter_contrast"))


@query("pr_export_settings", "SELECT p_partkey, w AS width, h AS height, CASE least(w, h) WHEN 720 THEN '720p' WHEN 1080 THEN '1080p' WHEN 2160 THEN '2160p' ELSE 'current' END AS resolution, CASE WHEN w % 2 <> 0 OR h % 2 <> 0 THEN 'size not even' WHEN abs(w * 1080 - h * 1920) > 1920 THEN 'aspect ratio' END AS error FROM (SELECT p_partkey, coalesce(nullif(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1280 WHEN 2 THEN 3840 WHEN 3 THEN 1281 END, 0), 1920) AS w, coalesce(nullif(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 720 WHEN 2 THEN 2160 WHEN 3 THEN 720 ELSE 720 END, 0), 1080) AS h FROM part)")
def export_settings(spark, d):
    k = F.col("p_partkey") % 5
    pick = lambda *v: F.get(F.array(*(F.lit(x).cast("int") for x in v)), k.cast("int"))
    none = F.lit(None).cast("int")
    job = {"width": pick(0, 1280, 3840, 1281, None), "height": pick(0, 720, 2160, 720, 720), "frame_rate": none, "resolution": F.lit(None).cast("string")}
    s = M.settings(job, {"width": none, "height": none, "frame_rate": none})
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", s.alias("s")).select("p_partkey", "s.width", "s.height", "s.resolution", "s.error")


#: Commands on two documents, for every form and failure.
COMMANDS = [
    "split here", "split clip 1 at 1.5s", "add text \"Hello\"", 'add text "Hi" at 3 sec', 'add text "x" at soon', "trim clip 2 from 1s to 2s", "trim clip 1 from a to b", "trim video 1 to 1s", "delete", "delete audio 1", "move text 1 to 18s",
    "set volume audio 1 to 50%", "set volume to 150 %", "change speed clip 1 to 2x", "change speed clip 1 to 0x", "Move  CLIP 1   TO 4 seconds", "delete nothing-like-this", "delete item", "", "make it pop", "trim clip 1 from 5s to 2s", "split clip 1 at 99999",
]


_PARSED = "(VALUES (0, 'split_here', 2.0::DOUBLE), (1, 'split_at', 1.5), (2, 'add_text', 2.0), (3, 'add_text', 3.0), (4, 'add_text', NULL), (5, 'trim_range', 1.0), (6, 'trim_range', NULL), (7, 'trim_to', 1.0), (8, 'delete', NULL), (9, 'delete', NULL), (10, 'move', 18.0), (11, 'volume', 50.0), (12, 'volume', 150.0), (13, 'speed', 2.0), (14, 'speed', 0.0), (15, 'move', 4.0), (16, 'delete', NULL), (17, 'delete', NULL), (18, NULL, NULL), (19, NULL, NULL), (20, 'trim_range', 5.0), (21, 'split_at', 99999.0)) v(id, form, a)"


@query("pl_parsed_commands", f"SELECT o_orderkey AS command_id, form, a FROM orders JOIN {_PARSED} ON id = o_orderkey % 22")
def parsed_commands(spark, d):
    """A command for each order, of every form and failure in turn."""
    texts = F.array(*(F.lit(c) for c in COMMANDS))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("command_id"), F.col("o_custkey").alias("document_id"), F.get(texts, (F.col("o_orderkey") % len(COMMANDS)).cast("int")).alias("command"), F.lit(2.0).alias("playhead"), F.lit(None).cast("string").alias("active_id"), F.array().cast("array<string>").alias("selected"))
    return P.parse(rows).select("command_id", "form", "a")


def _planned_sql() -> str:
    """The planner as SQL: every command beside every item of its document, matched stage by stage."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    whole = {name: text(rf"(?i)\A(?:{pattern})\z") for name, pattern, _ in P.FORMS}
    forms = " ".join(f"WHEN regexp_matches(own, {whole[n]}) THEN '{n}'" for n, _, _ in P.FORMS)
    taken = [" ".join(f"WHEN '{n}' THEN nullif(regexp_extract(own, {whole[n]}, {g[i]}), '')" for n, _, g in P.FORMS if g[i]) for i in range(3)]
    seconds = lambda x: rf"TRY_CAST(nullif(regexp_extract(lower(trim({x})), '\A(\d+(?:\.\d+)?)\s*(?:s|sec|secs|second|seconds)?\z', 1), '') AS DOUBLE)"
    return f"""{_ITEMS}, given AS (SELECT * FROM (VALUES {", ".join(f"({i}, {text(c)})" for i, c in enumerate(COMMANDS))}) v(no, command)),
 worded AS (SELECT *, trim(regexp_replace(command, '\\s+', ' ', 'g')) AS own FROM given),
 formed AS (SELECT *, CASE {forms} END AS form FROM worded),
 split AS (SELECT *, CASE form {taken[0]} END AS target, CASE form {taken[1]} END AS raw_a, CASE form {taken[2]} END AS raw_b FROM formed),
 parsed AS (SELECT no, command, form, target, lower(trim(target)) AS tt, CASE form WHEN 'volume' THEN 'audio' WHEN 'speed' THEN 'video' END AS kind, {seconds("raw_b")} AS b,
  CASE WHEN form IN ('volume', 'speed') THEN TRY_CAST(raw_a AS DOUBLE) WHEN form = 'split_here' OR (form = 'add_text' AND raw_a IS NULL) THEN 2.0 ELSE {seconds("raw_a")} END AS a FROM split),
 chosen AS (SELECT document_id, list(item_id ORDER BY item_id) AS selected, min(item_id) AS active_id FROM i WHERE layer_order = 1 GROUP BY document_id),
 r AS (SELECT document_id * 100 + no AS command_id, * FROM chosen, parsed),
 beside AS (SELECT i.*, r.command_id, r.tt, r.active_id, r.selected, regexp_extract(r.tt, {text(P.ORDINAL)}, 1) AS word, TRY_CAST(regexp_extract(r.tt, {text(P.ORDINAL)}, 2) AS INT) AS number
  FROM r JOIN i ON i.document_id = r.document_id WHERE r.form <> 'add_text' AND (r.kind IS NULL OR i.item_type = r.kind)),
 classed AS (SELECT *, coalesce(word = 'item' OR (word IN ('clip', 'video') AND item_type = 'video') OR (word IN ('audio', 'text') AND item_type = word), false) AS class_ok FROM beside),
 counted AS (SELECT *, sum(CAST(class_ok AS INT)) OVER (PARTITION BY command_id ORDER BY track_index, item_index) AS nth FROM classed),
 staged AS (SELECT *, CASE WHEN tt IS NULL THEN CASE WHEN item_id = active_id THEN 1 WHEN list_contains(selected, item_id) THEN 2 END WHEN lower(item_id) = tt THEN 1
  WHEN word <> '' THEN CASE WHEN class_ok AND nth = number THEN 2 END WHEN contains(lower(item_id), tt) OR coalesce(contains(lower(text), tt), false) THEN 3 END AS stage FROM counted),
 best AS (SELECT * FROM staged WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY command_id)),
 m AS (SELECT command_id, count(*) AS matches, arg_min(struct_pack(item_id, item_type, timeline_start, duration, source_in, source_out, speed), track_index * 1000000 + item_index) AS it FROM best GROUP BY command_id),
 x AS (SELECT r.*, coalesce(m.matches, 0) AS matches, m.it, coalesce(form = 'delete' AND target IS NULL, false) AS bare, coalesce(form IN ('trim_range', 'trim_to'), false) AS trims, coalesce(form IN ('split_here', 'split_at'), false) AS splits,
  CASE WHEN form = 'trim_to' THEN m.it.timeline_start ELSE a END AS first, CASE WHEN form = 'trim_to' THEN m.it.timeline_start + a ELSE b END AS last FROM r LEFT JOIN m ON m.command_id = r.command_id),
 y AS (SELECT *, round(last - first, 3) AS length, coalesce(nullif(it.speed, 0), 1) AS rate, round(a - it.timeline_start, 3) AS inner_at FROM x),
 z AS (SELECT *, round(it.source_in + (first - it.timeline_start) * rate, 3) AS s0 FROM y),
 w AS (SELECT *, round(s0 + length * rate, 3) AS s1, it.item_type IN ('video', 'audio') AS media FROM z),
 k AS (SELECT *, CASE WHEN trim(command) = '' THEN 'empty command' WHEN form IS NULL THEN 'unsupported command' WHEN a IS NULL AND form <> 'delete' THEN 'invalid time' WHEN form = 'trim_range' AND b IS NULL THEN 'invalid time'
  WHEN form = 'trim_range' AND b <= a THEN 'end before start' WHEN form = 'volume' AND NOT a BETWEEN 0 AND 100 THEN 'volume out of range' WHEN form = 'speed' AND a <= 0 THEN 'speed out of range' WHEN bare THEN NULL
  WHEN form <> 'add_text' AND matches = 0 THEN 'no match' WHEN form <> 'add_text' AND matches > 1 THEN 'ambiguous' WHEN trims AND last <= first THEN 'end before start'
  WHEN trims AND media AND NOT coalesce(s0 >= it.source_in AND s1 <= it.source_out AND s1 > s0, false) THEN 'outside source' WHEN splits AND (inner_at <= 0 OR inner_at >= it.duration) THEN 'split outside item' END AS reason FROM w)
 SELECT command_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN CASE form WHEN 'split_here' THEN 'splitItem' WHEN 'split_at' THEN 'splitItem' WHEN 'add_text' THEN 'addText' WHEN 'trim_range' THEN 'trimItem' WHEN 'trim_to' THEN 'trimItem'
  WHEN 'delete' THEN 'deleteItems' WHEN 'move' THEN 'moveItem' WHEN 'volume' THEN 'updateAudio' WHEN 'speed' THEN 'updateSpeed' END END AS action,
  CASE WHEN reason IS NULL THEN CASE WHEN bare THEN array_to_string(selected, ',') WHEN form <> 'add_text' THEN it.item_id END END AS item_ids,
  CASE WHEN reason IS NULL AND (trims OR splits OR form IN ('move', 'add_text')) THEN round(first, 3) END AS start, CASE WHEN reason IS NULL AND trims THEN length END AS duration,
  CASE WHEN reason IS NULL AND trims AND media THEN s0 END AS source_in, CASE WHEN reason IS NULL AND trims AND media THEN s1 END AS source_out,
  CASE WHEN reason IS NULL AND form = 'volume' THEN round(a / 100, 3) WHEN reason IS NULL AND form = 'speed' THEN round(a, 3) END AS value, reason FROM k"""


@query("pl_planned_commands", exact(_planned_sql(), 3))
def planned_commands(spark, d):
    """Every command on every document's timeline."""
    items, parts = _planned_items(spark, d)
    chosen = items.where("layer_order = 1").groupBy("document_id").agg(F.sort_array(F.collect_list("item_id")).alias("selected"), F.min("item_id").alias("active_id"))
    rows = chosen.withColumn("c", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("command")) for i, c in enumerate(COMMANDS)))))
    rows = rows.select((F.col("document_id") * 100 + F.col("c.i")).alias("command_id"), "document_id", "c.command", F.lit(2.0).alias("playhead"), "active_id", "selected")
    return P.plan(rows, items, parts)


_PLAN_MOVES = _ITEMS + ", f AS (SELECT document_id, item_id, row_number() OVER (PARTITION BY document_id ORDER BY track_index, item_index) AS n FROM i WHERE item_type = 'video') SELECT document_id, item_id AS item_ids, 4.5 AS start FROM f WHERE n = 2"


@query("pl_move_second_clip", _PLAN_MOVES.replace("4.5 AS", "4.5::DOUBLE AS"))
def move_second_clip(spark, d):
    items, parts = _planned_items(spark, d)
    rows = items.select("document_id").distinct().select(F.col("document_id").alias("command_id"), "document_id", F.lit("move clip 2 to 4.5s").alias("command"), F.lit(0.0).alias("playhead"), F.lit(None).cast("string").alias("active_id"), F.array().cast("array<string>").alias("selected"))
    return P.plan(rows, items, parts).where("ok").select(F.col("command_id").alias("document_id"), "item_ids", "start")
