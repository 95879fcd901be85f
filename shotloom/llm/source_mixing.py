"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 3). DataFrame functions only.

Each document draws u from a hash of its id and text, and its key is -ln(u) / quality weight; taking
the least keys of a source is weighted sampling without replacement. A source's budget is whole
epochs of all its documents first, then the least keys whose sizes add up to the rest.

The prefix sum has two levels. Keys fall into buckets by their logarithm; whatever the weights, a
bucket expects at most 1 / (e * FINE) of a source's documents, as x * exp(-x) is at most 1 / e. Bucket
sums per source are summed in order, and only the bucket in which a source's budget ends is sorted
by document, so a source with a third of all rows costs no task more than one bucket of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2
#: Buckets in which the key grows by a factor of e.
FINE = 1024
SEED = 7


def quality_weight(text, size):
    """Mean word length near that of prose and few symbols weigh up to 1, never under 0.1."""
    letters = F.length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>!", "")) / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters * letters * F.least(F.lit(1.0), (size + 1) / 50.0)))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with the rank i from 0 of each source, by code point and null last; range partitions are numbered on their own."""
    last = F.col("source").asc_nulls_last()
    own = C.cut(sizes.repartitionByRange(last).withColumn("part", F.spark_partition_id()))
    parts = own.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1)
    return own.join(F.broadcast(parts), "part").withColumn("i", F.col("begin") + F.col("r")).drop("part", "begin", "r")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources above their cap at the common level are set to it and the others share the rest by
    weight, until none is above. Each round is one aggregate over the sources.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("i", F.lit(len(weights))).cast("int"))
    ranked = C.cut(_ranked(sizes).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w")
        held, free = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not free:  # all are capped, or there is no source
            break
        new = (total - held) / free
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_hash, source, source_size, target, copies, taken) for every row of docs (doc_id, text, source), and the struct row of all its columns if carry is set.

    size counts words; null, empty and blank texts have size 0 and are never taken. copies is how
    often the mix takes the row, taken = copies * size. A source's taken words differ from its
    target by less than its largest document. Ties of a key fall by doc_id, then text hash; among
    rows of equal id, text and source any may be taken. Rows that share a doc_id or have none are
    rows like others. A null source is a source of its own and comes last. Empty tables give an
    empty result; extra columns are ignored but for row.
    """
    size = C.word_count(F.col("text"))
    whole = [F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_hash"), size.alias("size"), F.col("text").alias("__t"), *whole)
    rows = rows.withColumn("w", quality_weight(F.col("__t"), F.col("size"))).drop("__t")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text_hash").cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(u) / F.col("w"))
    rows = C.cut(rows.withColumn("bucket", F.floor(F.log(F.col("key")) * FINE).cast("int")).drop("w"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    targets = C.cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    edges = targets.withColumnRenamed("source", "s").join(sums, same, "left").groupBy("s", "source_size", "target", "epochs", "budget").agg(F.max(F.when(F.col("before") < F.col("budget"), F.struct("bucket", "before"))).alias("last"))
    # the last bucket that begins below the budget; none where the budget is 0
    edges = C.cut(edges.select("s", "source_size", "target", "epochs", "budget", F.coalesce("last.bucket", F.lit(-(1 << 31) + 1)).alias("edge"), "last.before"))
    rows = rows.join(edges, same).drop("s")
    sure = rows.where("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("int"))
    running = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("bucket = edge").withColumn("upto", F.col("before") + F.sum("size").over(running))
    fits = (F.col("upto") <= F.col("budget")) | (F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("size")))
    last = last.withColumn("extra", fits.cast("int")).drop("upto")
    both = sure.unionByName(last).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0))
    return both.select("doc_id", "size", "text_hash", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def op3_source_mixing(spark, sf_dir):
    found = mix_sources(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
q AS (SELECT *, length(translate(t, '#*$%&|<>!', '')) / greatest(length(t), 1) AS letters,
  (('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, h)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
k AS (SELECT *, -ln(u) / greatest(0.1::DOUBLE, least(1::DOUBLE, letters * letters * least(1::DOUBLE, (size + 1) / 50::DOUBLE))) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
i AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 2::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM i),
l AS (SELECT *, max(CASE WHEN (total - held) / free <= cap / w THEN (total - held) / free END) OVER () AS water FROM r),
g AS (SELECT source, source_size, least(cap, coalesce(water * w, cap)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
c AS (SELECT k.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, h ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN upto <= budget OR upto - budget < budget - (upto - size) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, source, copies::INTEGER AS copies FROM e"""
