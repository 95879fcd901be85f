"""Scalar function, cache, routing and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as Y
from ..functions import colours as CO
from ..functions import layout as L
from ..functions import numbers as U
from ..functions import text as X
from ..operators import cache as K
from ..operators import cache_table as CT
from ..operators import metrics as M
from ..operators import routing as R
from ..sources import adapters as A
from ..sources import files as S
from ..workspace import new_path
from .register import exact, query


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("sf_canonical_hash", "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS text_hash FROM documents")
def canonical_hash(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.sha256_hex(X.canonical_text(F.col("text"))).alias("text_hash"))


@query("sf_cache_key", "SELECT p_partkey, CASE WHEN trim(p_name, ':') <> '' THEN 'emb:' || trim(':' || p_brand || ':', ':') || ':' || trim(p_name, ':') END AS key FROM part")
def cache_key(spark, d):
    return _read(spark, d, "part").select("p_partkey", X.cache_key(F.lit("emb"), F.concat(F.lit(":"), "p_brand", F.lit(":")), F.col("p_name")).alias("key"))


@query("sf_shot_id", "SELECT event_id, event_type || ':shot:' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') AS shot_id FROM events")
def shot_id(spark, d):
    return _read(spark, d, "events").select("event_id", X.padded_id(F.concat("event_type", F.lit(":shot")), F.col("event_id") % 1000000, 6).alias("shot_id"))


@query("sf_collapse_space", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def collapse(spark, d):
    from ..operators.retrieval import collapse_space

    return _read(spark, d, "documents").select("doc_id", collapse_space(F.col("text")).alias("text"))


@query("sf_safe_path", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(p_name || '/' || p_brand, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 128), ''), 'job') AS path FROM part")
def safe(spark, d):
    return _read(spark, d, "part").select("p_partkey", X.safe_path(F.concat_ws("/", "p_name", "p_brand")).alias("path"))


@query("sf_basename", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'source' ELSE p_brand END AS name FROM part")
def base_name(spark, d):
    path = F.concat(F.lit("media/"), F.col("p_name"), F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")))
    return _read(spark, d, "part").select("p_partkey", X.basename(path, "source").alias("name"))


@query("sf_seconds_literal", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size END::DOUBLE AS seconds FROM part")
def seconds(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".5 Sec"))).when(k == 2, F.concat(F.lit(" "), n, F.lit("  seconds "))).when(k == 3, F.concat(n, F.lit(" minutes"))).otherwise(F.concat(F.lit("-"), n, F.lit("s")))
    return _read(spark, d, "part").select("p_partkey", X.seconds_literal(text).alias("seconds"))


@query("sf_setting_list", "SELECT p_partkey, p_brand || '|' || p_type AS settings FROM part")
def settings(spark, d):
    return _read(spark, d, "part").select("p_partkey", F.array_join(X.setting_list(F.concat(F.lit(" , "), "p_brand", F.lit(" ,, "), "p_type", F.lit(","))), "|").alias("settings"))


@query("sf_redacted_url", "SELECT s_suppkey, 'redis://***@' || s_name || ':6379/0' AS url FROM supplier")
def redacted(spark, d):
    return _read(spark, d, "supplier").select("s_suppkey", X.redact_url(F.concat(F.lit("redis://user:pw"), F.col("s_suppkey").cast("string"), F.lit("@"), "s_name", F.lit(":6379/0"))).alias("url"))


@query("sf_point_key", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS point_key FROM (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || CAST('shotloom:point:' || s_name AS BLOB)) AS h FROM supplier)")
def point_key(spark, d):
    logical = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))).otherwise(F.col("s_name"))
    return _read(spark, d, "supplier").select("s_suppkey", X.point_key(logical).alias("point_key"))


@query("sf_clamped", exact("SELECT event_id, least(100, greatest(5, value)) AS clamped, round(value / 3, 3) AS rounded FROM events", 3))
def clamped(spark, d):
    return _read(spark, d, "events").select("event_id", U.clamp(F.col("value"), 5, 100).alias("clamped"), U.round3(F.col("value") / 3).alias("rounded"))


@query("sf_strict_number", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN 7 ELSE 12.5 END::DOUBLE AS number FROM events")
def strict(spark, d):
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "NaN").when(k == 2, "true").when(k == 3, "Infinity").when(k == 4, "soon").otherwise(" 12.5 ")
    return _read(spark, d, "events").select("event_id", U.strict_number(text, 7.0).alias("number"))


@query("sf_tempo_factors", "SELECT p_partkey, p_size / 8.0 AS speed, 1 AS inside FROM part")
def tempo(spark, d):
    """The factors are each in [0.5, 2] and multiply to the speed."""
    rows = _read(spark, d, "part").select("p_partkey", (F.col("p_size") / 8.0).alias("s"))
    f = U.tempo_factors(F.col("s"))
    return rows.select("p_partkey", F.round(F.aggregate(f, F.lit(1.0), lambda a, x: a * x), 9).alias("speed"), F.forall(f, lambda x: x.between(0.5, 2)).cast("int").alias("inside"))


@query("sf_letterbox", "SELECT p_partkey, round(s, 9) AS scale, round((1920 - p_size * 16 * s) / 2, 6) AS offset_x, round((1080 - 900 * s) / 2, 6) AS offset_y, abs(1920 * 900 - 1080 * p_size * 16) <= greatest(p_size * 16, 900) AS aspect FROM (SELECT *, least(1920 / (p_size * 16.0), 1080 / 900.0) AS s FROM part)")
def letterbox(spark, d):
    w = F.col("p_size") * 16
    b = U.letterbox(F.lit(1920), F.lit(1080), w, F.lit(900))
    return _read(spark, d, "part").select("p_partkey", F.round(b["scale"], 9).alias("scale"), F.round(b["offset_x"], 6).alias("offset_x"), F.round(b["offset_y"], 6).alias("offset_y"), U.keeps_aspect(F.lit(1920), F.lit(1080), w, F.lit(900)).alias("aspect"))


_CANONICAL = "sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))))"


@query("ag_text_groups", f"SELECT doc_id AS pos, h AS text_hash, min(doc_id) OVER (PARTITION BY h) AS first_pos, count(*) OVER (PARTITION BY h) AS n FROM (SELECT doc_id, {_CANONICAL} AS h FROM documents WHERE trim(text) <> '')")
def text_groups(spark, d):
    """Every position with the group of its text: each text is grouped once, and the groups go back to the positions."""
    texts = _read(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return K.expand(texts, K.distinct_texts(texts)).select("pos", "text_hash", "first_pos", "n")


_CLASSES = "CASE WHEN c = ' ' THEN 4 WHEN c IN ('i', 'l', '.', ',') THEN 3 WHEN c IN ('m', 'w', 'M', 'W') THEN 11 ELSE 7 END"


@query("sf_wrapped_text", f"""WITH RECURSIVE w AS (SELECT p_partkey, str_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS words FROM part), m AS (SELECT *, list_transform(words, lambda x: list_sum(list_transform(str_split(x, ''), lambda c: {_CLASSES}))) AS size FROM w),
f(p_partkey, words, size, i, line, used, done) AS (SELECT p_partkey, words, size, 1, words[1], size[1], CAST([] AS VARCHAR[]) FROM m UNION ALL
 SELECT p_partkey, words, size, i + 1, CASE WHEN used + 4 + size[i + 1] <= 100 THEN line || ' ' || words[i + 1] ELSE words[i + 1] END, CASE WHEN used + 4 + size[i + 1] <= 100 THEN used + 4 + size[i + 1] ELSE size[i + 1] END, CASE WHEN used + 4 + size[i + 1] <= 100 THEN done ELSE list_append(done, line) END FROM f WHERE i < len(words))
SELECT p_partkey, array_to_string(list_append(done, line), '|') AS lines FROM f WHERE i = len(words)""")  # fmt: skip
def wrapped_text(spark, d):
    advances = F.create_map(*(F.lit(x) for chars, w in ((" ", 4.0), ("il.,", 3.0), ("mwMW", 11.0)) for c in chars for x in (c, w)))
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return _read(spark, d, "part").select("p_partkey", F.array_join(L.wrapped(text, advances, 100.0, 7.0), "|").alias("lines"))


@query("sk_exposition", """SELECT 'requests_total{{kind="' || event_type || '"}} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT '# HELP requests_total requests by kind' UNION ALL SELECT '# TYPE requests_total counter'""")
def exposition(spark, d):
    samples = M.counters(_read(spark, d, "events").select(F.col("event_type").alias("kind")), "kind")
    return M.exposition("requests", "counter", samples, "requests by kind").select("line")


@query("jn_expanded_results", "SELECT doc_id AS pos, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS text_hash, min(doc_id) OVER (PARTITION BY sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))))) AS encoded_at FROM documents WHERE trim(text) <> ''")
def expanded(spark, d):
    texts = _read(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    once = K.distinct_texts(texts).select("text_hash", F.col("first_pos").alias("encoded_at"))
    return K.expand(texts, once).select("pos", "text_hash", "encoded_at")


_LOOKUP = f"SELECT pos, CASE WHEN in_cache AND NOT corrupt THEN 'hit' WHEN in_cache THEN 'corrupt' WHEN in_legacy THEN 'legacy' ELSE 'miss' END AS outcome FROM ({A.CACHE_REQUESTS})"


def _lookup(spark, d):
    rows = A.load(spark, d, A.CACHE_REQUESTS)
    keys = rows.select("pos", "in_cache", "in_legacy", "corrupt", F.concat(F.lit("v2:"), F.col("pos").cast("string")).alias("key"), F.concat(F.lit("v1:"), F.col("pos").cast("string")).alias("legacy_key"))
    return K.lookup(keys.select("pos", "key", "legacy_key"), keys.where("in_cache").select("key", (~F.col("corrupt")).alias("valid")), keys.where("in_legacy").select(F.col("legacy_key").alias("key"), F.lit(True).alias("valid")))


@query("jn_cache_second_chance", _LOOKUP)
def second_chance(spark, d):
    return _lookup(spark, d).select("pos", "outcome")


@query("jn_cache_bucketed", _LOOKUP)
def cache_bucketed(spark, d):
    """The second chance over two stored cache tables, which the lookups read in place."""
    rows = A.load(spark, d, A.CACHE_REQUESTS)
    name = lambda v: F.concat(F.lit(v), F.col("pos").cast("string"))
    current = CT.CacheTable.write(rows.where("in_cache").select(name("v2:").alias("key"), (~F.col("corrupt")).alias("valid")), 16)
    legacy = CT.CacheTable.write(rows.where("in_legacy").select(name("v1:").alias("key"), F.lit(True).alias("valid")), 16)
    return CT.second_chance(rows.select("pos", name("v2:").alias("key"), name("v1:").alias("legacy_key")), current, legacy).select("pos", "outcome")


@query("ag_lookup_outcomes", f"SELECT outcome, count(*) AS n FROM ({_LOOKUP}) GROUP BY outcome")
def outcomes(spark, d):
    return M.counters(_lookup(spark, d), "outcome")


@query("st_legacy_promoted", f"SELECT 'v2:' || CAST(pos AS VARCHAR) AS key FROM ({_LOOKUP}) WHERE outcome = 'legacy'")
def promoted(spark, d):
    return _lookup(spark, d).where("outcome = 'legacy'").select("key")


@query("sk_cache_put", "SELECT p_brand AS key, CASE WHEN bool_or(p_partkey % 2 = 0) THEN arg_max(p_name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END) ELSE 'old' END AS value FROM part GROUP BY p_brand")
def cache_put(spark, d):
    part = _read(spark, d, "part")
    now = F.lit("2024-01-01").cast("timestamp")
    base = part.select(F.col("p_brand").alias("key")).distinct().select("key", F.lit("old").cast("binary").alias("value"), now.alias("expires_at"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("key"), F.col("p_name").cast("binary").alias("value"), now.alias("expires_at"), F.col("p_partkey").alias("seq"))
    return K.put(base, new).select("key", F.col("value").cast("string").alias("value"))


@query("sc_bulk_get", "SELECT p.p_partkey AS pos, p.p_brand AS key, s.s_name AS value FROM part p LEFT JOIN supplier s ON p.p_brand = 'Brand#' || CAST(s.s_suppkey AS VARCHAR) AND s.s_suppkey % 2 = 0")
def bulk_get(spark, d):
    stored = _read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))
    return K.bulk_get(_read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("key")), stored)


@query("st_ttl_expiry", "SELECT event_id FROM events WHERE ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-15 00:00:00'")
def expiry(spark, d):
    rows = _read(spark, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL '3' DAY")).alias("expires_at"))
    return K.live(rows, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id")


@query("jn_scope_containment", "SELECT o_custkey, bool_and(lower(o_orderpriority) IN ('1-urgent', '2-high', '3-medium', '5-low')) AS inside FROM orders GROUP BY o_custkey")
def containment(spark, d):
    trusted = F.array(*(F.lit(x) for x in (" 1-URGENT", "2-high", "3-Medium ", "5-LOW")))
    rows = _read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ids"))
    return rows.select("o_custkey", K.within_scope(F.col("ids"), trusted).alias("inside"))


@query("fl_result_admissible", "SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 4 <> 0 AND trim(text) <> '' AS ok FROM documents")
def admissible(spark, d):
    scope = F.when(F.col("doc_id") % 3 == 1, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    scope = F.when((F.col("doc_id") % 3 == 1), F.concat(scope, F.lit("x"))).otherwise(scope)
    media = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m1")))
    return _read(spark, d, "documents").select("doc_id", K.result_cacheable(scope, media, F.col("text"), F.array(F.lit("ocr"))).alias("ok"))


@query("sf_envelope", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS payload FROM part")
def envelope(spark, d):
    good = K.envelope(F.col("p_name"), F.lit("2024-01-01T00:00:00Z"))
    value = F.when(F.col("p_partkey") % 3 == 0, good).when(F.col("p_partkey") % 3 == 1, F.lit("{broken")).otherwise(F.replace(good, F.lit('"schema_version":1'), F.lit('"schema_version":2')))
    return _read(spark, d, "part").select("p_partkey", K.open_envelope(value).alias("payload"))


@query("sf_vector_codec", "SELECT vec_id, 'ok' AS state, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def codec(spark, d):
    rows = _read(spark, d, "embeddings").withColumn("h", F.sha2(F.col("vec_id").cast("string"), 256))
    rows = rows.withColumn("data", K.packed(F.col("embedding"), F.col("h"), b"c" * 32)).withColumn("u", K.unpacked(F.col("data"), F.col("h"), b"c" * 32, 64))
    return rows.select("vec_id", "u.state", F.round(F.aggregate("u.vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_ROUTED = f"""SELECT event_id, attempt, CASE WHEN broken <> '' THEN 'dead_letter' WHEN NOT handler_failed THEN 'done' WHEN attempt + 1 < 3 THEN 'retry' ELSE 'failed' END AS route, nullif(broken, '') AS error
 FROM (SELECT *, CASE WHEN attempt_header IN ('0', '1', '2') THEN CAST(attempt_header AS INT) ELSE 0 END AS attempt, CASE WHEN event_id % 17 = 0 THEN 'json' WHEN event_id % 19 = 0 THEN 'unknown key' WHEN event_id % 23 = 0 THEN 'kind' ELSE '' END AS broken FROM ({A.MESSAGES}))"""


@query("st_routed_messages", _ROUTED)
def routed(spark, d):
    return R.route(A.load(spark, d, A.MESSAGES)).select("event_id", "attempt", "route", "error")


@query("st_route_counts", f"SELECT route, count(*) AS n, sum(CASE WHEN route = 'retry' THEN CASE attempt WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 600 END END)::BIGINT AS delay FROM ({_ROUTED}) GROUP BY route")
def route_counts(spark, d):
    return R.route(A.load(spark, d, A.MESSAGES)).groupBy("route").agg(F.count("*").alias("n"), F.sum("delay_seconds").alias("delay"))


@query("st_circuit_breaker", """WITH RECURSIVE c AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i,
 date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS t, coalesce(value > 20, FALSE) AS failed FROM events),
s(key, i, fails, opened, state) AS (SELECT key, 0::BIGINT, 0, NULL::DOUBLE, NULL::VARCHAR FROM c GROUP BY key UNION ALL
 SELECT c.key, c.i, CASE WHEN c.t < s.opened + 10 THEN s.fails WHEN c.failed THEN s.fails + 1 ELSE 0 END,
 CASE WHEN c.t < s.opened + 10 THEN s.opened WHEN c.failed AND (s.opened IS NOT NULL OR s.fails + 1 >= 5) THEN c.t END,
 CASE WHEN c.t < s.opened + 10 THEN 'open' WHEN s.opened IS NOT NULL THEN 'half-open' ELSE 'closed' END FROM s JOIN c ON c.key = s.key AND c.i = s.i + 1)
SELECT key, state, count(*) AS n FROM s WHERE i > 0 GROUP BY key, state""")
def breaker(spark, d):
    """Calls of each event type by id; two numbers of state a key."""
    calls = _read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6).alias("t"), (F.col("value") > 20).alias("failed"))
    return R.breaker_states(calls).groupBy("key", "state").agg(F.count("*").alias("n"))


_BOUNDS = ", ".join(f"('{b}', {b})" for b in M.BOUNDS)


@query("ag_histogram", f"SELECT source, le, count(*) FILTER (strlen(text) <= b) AS n FROM documents, (VALUES {_BOUNDS}, ('+Inf', 1000000000000)) v(le, b) GROUP BY source, le")
def histogram(spark, d):
    return M.histogram(_read(spark, d, "documents"), "source", F.octet_length("text"))


@query("ag_health", "SELECT s_nationkey, CASE WHEN bool_or(s_suppkey % 3 = 0 AND s_acctbal < 1000) THEN 'unhealthy' WHEN bool_or(s_acctbal < 1000) THEN 'degraded' ELSE 'healthy' END AS status FROM supplier GROUP BY s_nationkey")
def health(spark, d):
    return M.health(_read(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 3 == 0).alias("required"), (F.col("s_acctbal") >= 1000).alias("healthy")), "s_nationkey")


@query("ag_distinct_first", "SELECT l_suppkey, array_to_string(list(l_partkey ORDER BY f), ',') AS parts FROM (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL) GROUP BY l_suppkey".replace("ORDER BY f", "ORDER BY f, l_partkey"))
def distinct_first(spark, d):
    """Distinct parts of a supplier in the order of their first row."""
    found = Y.distinct_in_order(_read(spark, d, "lineitem"), "l_suppkey", "l_partkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return found.select("l_suppkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


@query("ag_sorted_distinct", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT lower(o_orderpriority))), ',') AS ids FROM orders GROUP BY o_custkey")
def sorted_distinct(spark, d):
    return _read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(Y.sorted_distinct(F.col("o_orderpriority")), ",").alias("ids"))


@query("jn_positional_zip", "SELECT vec_id, len(embedding) = 64 AS matched, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), range(64)), lambda x: x[1] * x[2])), 6) AS dot FROM embeddings")
def positional(spark, d):
    pairs = Y.zipped(F.col("embedding").cast("array<double>"), F.sequence(F.lit(0), F.lit(63)))
    return _read(spark, d, "embeddings").select("vec_id", pairs.isNotNull().alias("matched"), F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["a"] * x["b"]), 6).alias("dot"))


@query("sf_map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'kept' ELSE 'e' || CAST(event_id % 5 AS VARCHAR) END AS first_error, CAST(event_id % 3 AS VARCHAR) AS attempt FROM events")
def map_merge(spark, d):
    """Retry headers: setdefault of the first error, later keys win."""
    error = F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string"))
    headers = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x-first-error"), F.lit("kept"), F.lit("x-attempt"), F.lit("9"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    merged = R.stamped_headers(headers, F.col("event_id") % 3, error)
    return _read(spark, d, "events").select("event_id", F.try_element_at(merged, F.lit("x-first-error")).alias("first_error"), F.try_element_at(merged, F.lit("x-attempt")).alias("attempt"))


@query("sc_font_catalog", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'fonts/inter-' WHEN 1 THEN 'fonts/mono-' ELSE 'fonts/inter-' END || CASE WHEN p_size % 2 = 0 THEN 'bold.ttf' ELSE 'regular.ttf' END AS file FROM part")
def fonts(spark, d):
    """Family and weight, with the default family as the fallback."""
    path = new_path(spark, "fonts")
    spark.createDataFrame([(f, w, f"fonts/{f.lower()}-{w}.ttf") for f in ("Inter", "Mono") for w in ("bold", "regular")], "family string, weight string, file string").write.json(path)
    k = F.col("p_size") % 3
    rows = _read(spark, d, "part").select("p_partkey", F.when(k == 0, "Inter").when(k == 1, "Mono").otherwise("Comic").alias("family"), F.when(F.col("p_size") % 2 == 0, "bold").otherwise("regular").alias("weight"))
    return S.font_files(rows, S.font_catalog(spark, path), "Inter").select("p_partkey", "file")


@query("sc_object_exists", "SELECT p_partkey, p_partkey % 100 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 1) AS found FROM part")
def exists(spark, d):
    listing = _read(spark, d, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("objects/"), "s_suppkey").alias("path"))
    keys = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("objects/"), F.col("p_partkey") % 100).alias("path"))
    return S.exists(keys, listing).select("p_partkey", "found")


@query("st_started_events", f"SELECT event_id, 'started' AS event, attempt FROM ({_ROUTED}) WHERE error IS NULL")
def started(spark, d):
    return R.started_events(A.load(spark, d, A.MESSAGES))


@query("sf_colour", "SELECT p_partkey, (CASE p_partkey % 4 WHEN 2 THEN 255 WHEN 3 THEN 176 ELSE p_partkey % 16 * 17 END)::INT AS r, (CASE p_partkey % 4 WHEN 1 THEN 240 ELSE 255 END)::INT AS a FROM part")
def colours(spark, d):
    digit = F.lower(F.hex(F.col("p_partkey") % 16))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" #"), digit, digit, digit)).when(k == 1, F.concat(F.lit("#"), digit, digit, F.lit("00fFF0"))).when(k == 2, "chartreuse?").otherwise(" PowderBlue")
    return _read(spark, d, "part").select("p_partkey", CO.colour(text).alias("c")).select("p_partkey", "c.r", "c.a")


@query("sf_shot_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS occurred_at FROM events")
def timestamps(spark, d):
    """Times as ISO text with a Z."""
    return _read(spark, d, "events").select("event_id", X.iso_utc(F.col("ts")).alias("occurred_at"))
