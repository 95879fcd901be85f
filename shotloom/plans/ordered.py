"""Queries along an order: the sweep line, as-of joins, keyframes as rows and shot cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest as M
from ..operators import ordered as O
from ..sources import adapters as A
from .register import query
from .timeline import _VISUAL

_FRAMES = "CAST(ceil(timeline_start * 2) AS BIGINT) AS a, CAST(ceil((timeline_start + duration) * 2) AS BIGINT) AS b"


def _visual(spark, d):
    return M.usable_items(A.load(spark, d, A.ITEMS)).where(F.col("item_type").isin(*M.VISUAL_TYPES))


@query("jn_active_segments", _VISUAL + f""", o AS (SELECT document_id, track_index, {_FRAMES} FROM v), c AS (SELECT document_id, a AS f, 1 AS n, track_index AS w FROM o WHERE b > a UNION ALL SELECT document_id, b, -1, -track_index FROM o WHERE b > a),
g AS (SELECT document_id, f, sum(n) AS n, sum(w) AS w FROM c GROUP BY document_id, f HAVING sum(n) <> 0 OR sum(w) <> 0), s AS (SELECT document_id, f, lead(f) OVER k - 1 AS t, sum(n) OVER k AS layers, sum(w) OVER k AS weight_sum FROM g WINDOW k AS (PARTITION BY document_id ORDER BY f))
SELECT document_id, f AS from_frame, t AS to_frame, layers::BIGINT AS layers, weight_sum::BIGINT AS weight_sum FROM s WHERE layers > 0""")  # fmt: skip
def active_segments(spark, d):
    return O.active_segments(_visual(spark, d), 2)


@query("jn_frames_of_segments", _VISUAL + f" SELECT document_id, frame, count(*) AS layers, sum(track_index)::BIGINT AS track_sum FROM (SELECT document_id, track_index, unnest(range(a, b)) AS frame FROM (SELECT document_id, track_index, {_FRAMES} FROM v)) GROUP BY document_id, frame")
def frames_of_segments(spark, d):
    """The segments, expanded: the rows of jn_active_frames."""
    rows = O.active_segments(_visual(spark, d), 2)
    return rows.select("document_id", F.explode(F.sequence("from_frame", "to_frame")).alias("frame"), "layers", F.col("weight_sum").alias("track_sum"))


@query("jn_asof_sales", """WITH s AS (SELECT client_id, sold_at, max(struct_pack(total, sale_id)) AS m FROM (SELECT client_id, sold_at, coalesce(total, -1e9) AS total, sale_id FROM sales) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY client_id, sold_at)
SELECT c.click_id, c.client_id, s.m.sale_id AS sale_id, date_diff('second', s.sold_at, c.ts) AS age FROM (SELECT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL) c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts >= s.sold_at
UNION ALL SELECT click_id, client_id, NULL, NULL FROM clicks WHERE client_id IS NULL OR ts IS NULL""")  # fmt: skip
def asof_sales(spark, d):
    """Each click with the last sale of its client until then; the client with the most rows is cut into parts like any other rows."""
    clicks = spark.read.parquet(f"{d}/clicks.parquet").select("click_id", "client_id", F.col("ts").alias("at"))
    sales = spark.read.parquet(f"{d}/sales.parquet").select("client_id", F.col("sold_at").alias("at"), F.coalesce("total", F.lit(-1e9)).alias("total"), "sale_id")
    found = O.asof_join(clicks, sales.select("client_id", "at", "total", "sale_id"), ["client_id"], "at")
    return found.select("click_id", "client_id", "matched.sale_id", F.timestamp_diff("SECOND", F.date_trunc("second", "matched.at"), F.date_trunc("second", "at")).alias("age"))


_KEYFRAMES = "SELECT track_id, timeline_start AS time, max(opacity_drop) AS value FROM i GROUP BY track_id, timeline_start"


@query("jn_keyframe_rows", f"""WITH i AS ({A.ITEMS}), k AS ({_KEYFRAMES}), q AS (SELECT item_id, track_id, duration * 4 AS time FROM i),
l AS (SELECT q.*, k.time AS t0, k.value AS v0 FROM q ASOF LEFT JOIN k ON q.track_id = k.track_id AND q.time >= k.time), r AS (SELECT l.*, k.time AS t1, k.value AS v1 FROM l ASOF LEFT JOIN k ON l.track_id = k.track_id AND l.time <= k.time)
SELECT item_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 = time THEN v1 ELSE v0 + (v1 - v0) * ((time - t0) / (t1 - t0)) END, 9) AS value FROM r""")  # fmt: skip
def keyframe_rows(spark, d):
    items = A.load(spark, d, A.ITEMS)
    keyframes = items.groupBy("track_id", F.col("timeline_start").alias("time")).agg(F.max("opacity_drop").alias("value")).withColumn("easing", F.lit(None).cast("array<double>"))
    queries = items.select("item_id", "track_id", (F.col("duration") * 4).alias("time"))
    return O.keyframe_values(queries, keyframes).select("item_id", F.round("value", 9).alias("value"))


@query("in_shot_cuts", f"""WITH RECURSIVE p AS ({A.POINTS}), f AS (SELECT media_id, vec_id AS frame, vector FROM p), d AS (SELECT media_id, frame, vector, lag(vector) OVER (PARTITION BY media_id ORDER BY frame) AS w FROM f),
e AS (SELECT media_id, frame, CASE WHEN w IS NOT NULL THEN 1 - list_dot_product(w, vector) / (sqrt(list_dot_product(w, w)) * sqrt(list_dot_product(vector, vector))) END AS distance FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS i FROM e WHERE distance IS NULL OR distance >= 0.9),
z(media_id, frame, distance, i, last, kept) AS (SELECT media_id, frame, distance, i, frame, true FROM c WHERE i = 1 UNION ALL
 SELECT c.media_id, c.frame, c.distance, c.i, CASE WHEN c.frame - z.last >= 45 THEN c.frame ELSE z.last END, c.frame - z.last >= 45 FROM z JOIN c ON c.media_id = z.media_id AND c.i = z.i + 1)
SELECT media_id, frame, round(distance, 9) AS distance FROM z WHERE kept AND distance IS NOT NULL""")  # fmt: skip
def in_shot_cuts(spark, d):
    points = A.load(spark, d, A.POINTS).select("media_id", F.col("vec_id").alias("frame"), "vector")
    return O.shot_cuts(points, 0.9, 45).select("media_id", "frame", F.round("distance", 9).alias("distance"))
