"""Schemas of nodes, edges, points, messages and cache entries, as DDL text."""

from __future__ import annotations

#: Vector collections and their dimensions. Fixed values.
DIMENSIONS = {"visual": 512, "transcript": 384, "audio": 1024, "ocr": 384}
COLLECTIONS = {f"{scope}_{kind}": DIMENSIONS[kind] for scope in ("shots", "media") for kind in ("visual", "transcript", "audio", "ocr")}


VIDEO = "media_id STRING, duration_seconds DOUBLE, width BIGINT, height BIGINT, frame_rate DOUBLE, object_key STRING"
AUDIO = "media_id STRING, duration_seconds DOUBLE, sample_rate BIGINT, channels BIGINT, object_key STRING"
IMAGE = "media_id STRING, width BIGINT, height BIGINT, object_key STRING"
SHOT = "shot_id STRING, media_id STRING, shot_index BIGINT, start_seconds DOUBLE, end_seconds DOUBLE, duration_seconds DOUBLE"
EDGE = "src STRING, dst STRING"
PAYLOAD = "pointId STRING, shotId STRING, mediaId STRING, projectId STRING, modality STRING, startSeconds DOUBLE, endSeconds DOUBLE, text STRING"
POINT = f"collection STRING, point_id STRING, media_id STRING, vector ARRAY<FLOAT>, payload STRUCT<{PAYLOAD}>"
CACHE = "key STRING, value BINARY, expires_at TIMESTAMP"
MESSAGE = "key STRING, value STRING, headers MAP<STRING, STRING>"
SEGMENT = "media_id STRING, pos BIGINT, start_seconds DOUBLE, end_seconds DOUBLE, text STRING"
KEYFRAME = "time DOUBLE, value DOUBLE, easing ARRAY<DOUBLE>"
#: Keys that an ingestion request may have; others make it invalid. Fixed values.
REQUEST_KEYS = ("mediaId", "projectId", "bucket", "objectKey", "kind", "occurredAt")
