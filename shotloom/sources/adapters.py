"""Inputs of the operators, bound to the supplied tables. One text serves Spark and the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Microseconds since 2024-01-01, in either dialect.
_EPOCH = {"spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "duck": "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)"}

POINTS = """
SELECT vec_id, CAST(vec_id % 2 AS INT) AS ord, CASE WHEN vec_id % 2 = 0 THEN 'transcript' ELSE 'ocr' END AS modality,
  CASE WHEN vec_id % 37 = 5 THEN NULL ELSE 'shot-' || lpad(CAST(CAST(floor(vec_id / 2) AS BIGINT) AS STRING), 6, '0') END AS shot_id,
  'm' || CAST(CAST(floor(vec_id / 2) AS BIGINT) % 10 AS STRING) AS media_id,
  CAST(CAST(floor(vec_id / 2) AS BIGINT) % 50 AS DOUBLE) * 4 AS start_seconds,
  CAST(CAST(floor(vec_id / 2) AS BIGINT) % 50 AS DOUBLE) * 4 + 4 AS end_seconds,
  CASE WHEN label % 5 = 0 THEN ' ' ELSE ' label  ' || CAST(label AS STRING) || ' ' END AS text,
  CAST(embedding AS {doubles}) AS vector
FROM {embeddings}"""

SHOTS = """
SELECT 'c' || CAST(conv_id AS STRING) AS media_id, turn AS shot_index,
  'c' || CAST(conv_id AS STRING) || ':shot:' || lpad(CAST(turn AS STRING), 6, '0') AS shot_id,
  CAST(turn AS DOUBLE) * 4 AS start_seconds, CAST(turn AS DOUBLE) * 4 + 4 AS end_seconds, role, text
FROM {conversations}"""

SEGMENTS = """
SELECT event_type AS media_id, event_id AS pos, {epoch} / 1e6 AS start_seconds, {epoch} / 1e6 + value * 60 AS end_seconds,
  CASE WHEN event_id % 13 = 0 THEN '  ' ELSE CAST(event_id AS STRING) END AS text
FROM {events}"""

GRID = """
SELECT media_id, CAST(i AS BIGINT) AS shot_index, media_id || ':shot:' || lpad(CAST(i AS STRING), 6, '0') AS shot_id,
  CAST(i AS DOUBLE) * 21600 AS start_seconds, CAST(i AS DOUBLE) * 21600 + 21600 AS end_seconds
FROM (SELECT DISTINCT event_type AS media_id FROM {events}) m, {numbers} n"""

BLOCKS = """
SELECT l_orderkey AS frame_id, l_partkey % 100 AS media_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  CASE WHEN l_linenumber % 5 = 0 THEN '   ' ELSE ' w' || CAST(l_partkey AS STRING) END AS text, l_discount * 10 AS confidence
FROM {lineitem}"""

TRACKS = """
SELECT o_custkey AS document_id, o_orderkey AS track_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS track_index,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'video' WHEN '2' THEN 'video' WHEN '3' THEN 'audio' WHEN '4' THEN 'overlay' ELSE 'text' END AS track_kind,
  o_orderstatus = 'F' AS hidden, o_orderstatus = 'P' AS muted
FROM {orders}"""

ITEMS = """
SELECT t.document_id, t.track_id, t.track_index, t.track_kind, t.hidden, t.muted, i.item_index,
  'item-' || CAST(i.l_orderkey AS STRING) || '-' || CAST(i.item_index AS STRING) AS item_id,
  CASE i.l_returnflag || i.l_linestatus WHEN 'RO' THEN 'video' WHEN 'NO' THEN 'video' WHEN 'RF' THEN 'image' WHEN 'AF' THEN 'audio' WHEN 'AO' THEN 'overlay' ELSE 'text' END AS item_type,
  i.l_quantity AS timeline_start, CAST(i.l_linenumber AS DOUBLE) * 1.5 AS duration,
  CASE WHEN i.l_suppkey % 3 = 0 THEN 'group-' || CAST(i.l_suppkey % 7 AS STRING) END AS linked_group,
  CAST(i.l_partkey % 5 AS INT) AS layer_order, 'media-' || CAST(i.l_partkey AS STRING) AS media_id,
  i.l_partkey % 11 = 0 AS item_muted, CAST(i.l_partkey % 4 AS DOUBLE) AS source_in,
  CAST(i.l_partkey % 4 AS DOUBLE) + CAST(i.l_linenumber AS DOUBLE) * 3 AS source_out,
  CASE i.l_suppkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 1.5 END AS speed,
  CAST(i.l_suppkey % 3 AS DOUBLE) / 4 AS fade_in, CAST(i.l_suppkey % 5 AS DOUBLE) / 4 AS fade_out, i.l_discount AS opacity_drop,
  CASE WHEN i.l_suppkey % 6 = 0 THEN '' ELSE 'Title ' || CAST(i.l_suppkey AS STRING) END AS text
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS item_index FROM {lineitem}) i
JOIN (""" + TRACKS + """) t ON t.track_id = i.l_orderkey"""

MEDIA = """
SELECT 'media-' || CAST(p_partkey AS STRING) AS media_id, CASE p_partkey % 3 WHEN 0 THEN 'Video' WHEN 1 THEN '1' ELSE 'x.image' END AS kind,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name, 'media/' || CAST(p_partkey AS STRING) || '/canonical.mp4' AS object_key,
  CAST(p_size * 40 AS BIGINT) AS width, CAST(CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size * 20 END AS BIGINT) AS height, CAST(p_size AS DOUBLE) AS duration_seconds
FROM {part}"""

METADATA = """
SELECT p_partkey AS media_no, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE p_retailprice END AS probed_duration,
  CASE p_partkey % 3 WHEN 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS requested_duration,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_type END AS probed_codec, p_brand AS requested_codec,
  CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END AS BIGINT) AS probed_width, CAST(p_size * 2 AS BIGINT) AS requested_width
FROM {part}"""

MESSAGES = """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{{broken' WHEN event_id % 19 = 0 THEN '{{"mediaId":"m' || CAST(event_id AS STRING) || '","extra":1}}'
  ELSE '{{"mediaId":"m' || CAST(event_id AS STRING) || '","kind":"' || CASE WHEN event_id % 23 = 0 THEN 'Poem' ELSE 'Video' END || '"}}' END AS value,
  CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN 'x' ELSE NULL END AS attempt_header, value > 100 AS handler_failed
FROM {events}"""

CACHE_REQUESTS = """
SELECT doc_id AS pos, text, doc_id % 4 = 0 AS in_cache, doc_id % 6 = 0 AS in_legacy, doc_id % 12 = 4 AS corrupt FROM {documents}"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


def duck(sql: str) -> str:
    """The text for the checking engine."""
    return sql.format(doubles="DOUBLE[]", epoch=_EPOCH["duck"], numbers="(SELECT unnest(range(120)) AS i)", **{t: t for t in _TABLES})


#: Rows of a task of the windows over line items and of what follows them without another exchange.
TASK_ROWS = 200_000


def _in_small_tasks(rows: DataFrame, key: str) -> DataFrame:
    """rows of a file in the partitioning that a window over key needs, in so many tasks that none grows with the table; smaller tables are left to adaptive execution."""
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n, key) if n > rows.sparkSession.sparkContext.defaultParallelism else rows


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The input as a DataFrame; only the tables it names are opened."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql}
    if "{numbers}" in sql:
        names["numbers"] = spark.range(120).withColumnRenamed("id", "i")
    if "PARTITION BY l_orderkey" in sql:
        names["lineitem"] = _in_small_tasks(names["lineitem"], "l_orderkey")
    sql = sql.replace("{doubles}", "ARRAY<DOUBLE>").replace("{epoch}", _EPOCH["spark"])
    return spark.sql(sql, **names)
