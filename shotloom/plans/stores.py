"""Queries of the stores that write: the vector index, the keyed table and the index writer. Each writes its table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed_table as K
from ..operators import vector_index as I
from ..sources import adapters as A
from ..workspace import new_path
from .register import query

_PROBES = 4


def _index(spark, d):
    points = A.load(spark, d, A.POINTS)
    return points, I.build(points, new_path(spark, "index"), max(1, min(4096, int(points.count() ** 0.5))))


@query("vs_ivf_exact_topk", f"""WITH p AS ({A.POINTS}), q AS (SELECT vector AS q FROM p WHERE vec_id = 0),
s AS (SELECT vec_id, media_id, list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q))) AS score FROM p, q)
SELECT vec_id, media_id, round(score, 9) AS score, row_number() OVER (ORDER BY s.score DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 50""")  # fmt: skip
def ivf_exact_topk(spark, d):
    """The whole nearest-cell search: few cells first, then every cell whose bound reaches the fiftieth score."""
    points, index = _index(spark, d)
    q = points.where("vec_id = 0").select("vector").first()
    found = I.search_exact(index, spark, list(q[0]) if q else [1.0], 50, _PROBES)
    return found.select("vec_id", "media_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vs_ivf_many", f"""WITH p AS ({A.POINTS}), s AS (SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(p.vector, q.vector) / (sqrt(list_dot_product(p.vector, p.vector)) * sqrt(list_dot_product(q.vector, q.vector))) AS score FROM p, p q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def ivf_many(spark, d):
    """Every vector whose id is divisible by 20 against all, with all cells probed, which equals the exact search."""
    points, index = _index(spark, d)
    queries = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found = I.search_many(index, queries, 10, len(index.centres))
    return found.select("query_id", "vec_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("sk_keyed_table", """WITH base AS (SELECT p_brand AS brand, p_partkey AS id, p_name AS name, 0 AS stage FROM part),
one AS (SELECT * FROM base WHERE brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size % 10 = 3) UNION ALL SELECT p_brand, p_partkey, p_type, 1 FROM part WHERE p_size % 10 = 3),
two AS (SELECT * FROM one WHERE brand NOT IN (SELECT 'Brand#' || (s_suppkey % 20) FROM supplier)), last AS (SELECT * FROM two WHERE brand <> 'supplier' UNION ALL SELECT 'supplier', s_suppkey, s_name, 3 FROM supplier)
SELECT brand, id, name, stage FROM last""")  # fmt: skip
def keyed_table(spark, d):
    """Parts by brand: brands with a part of a certain size are replaced, those named after suppliers are cleared, suppliers are added; half of the buckets are compacted in between."""
    part, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "supplier"))
    t = K.KeyedTable(spark, new_path(spark, "keyed"), "brand string, id long, name string, stage int", "brand", 16)
    rows = lambda name, stage: part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col(name).alias("name"), F.lit(stage).alias("stage"), "p_size")
    t.replace(rows("p_name", 0))
    t.replace(rows("p_type", 1).where("p_size % 10 = 3"))
    t.clear(supplier.select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 20).alias("brand")))
    t.compact(set(range(8)))
    t.replace(supplier.select(F.lit("supplier").alias("brand"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(3).alias("stage")))
    return t.content()


@query("sk_index_writer", f"""WITH p AS ({A.POINTS}) SELECT vec_id, media_id, 'first' AS version FROM p WHERE media_id NOT IN ('m1', 'm4') UNION ALL SELECT vec_id, media_id, 'second' FROM p WHERE media_id = 'm4' AND vec_id % 3 = 0""")
def index_writer(spark, d):
    """Points by media: a first write, a write with one wrong vector that must change nothing, and one that replaces one media and clears another."""
    points = A.load(spark, d, A.POINTS).withColumnRenamed("modality", "collection")
    t = K.KeyedTable(spark, new_path(spark, "points"), "vec_id long, media_id string, collection string, vector array<double>, version string", "media_id", 16)
    size = points.select(F.size("vector")).first()
    dimensions = dict.fromkeys(("transcript", "ocr"), size[0] if size else 0)
    media = points.select("media_id").distinct()
    K.write_points(t, points.withColumn("version", F.lit("first")), media, dimensions)
    wrong = points.withColumns({"version": F.lit("wrong"), "vector": F.when(F.col("vec_id") == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector"))})
    try:
        K.write_points(t, wrong, media, dimensions)
    except Exception as e:
        if "dimension" not in str(e):
            raise
    second = points.where("media_id = 'm4' and vec_id % 3 = 0").withColumn("version", F.lit("second"))
    K.write_points(t, second, media.where("media_id in ('m1', 'm4')"), dimensions)
    return t.content().select("vec_id", "media_id", "version")
