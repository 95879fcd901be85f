"""The corpus pipeline: quality rules, near duplicates, decontamination, source mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the shared folder and hands the reread table to the next. All but the last return the columns of
documents. SQL can't express the learned, iterative and packed stages, so ORACLE_SQL is None;
tests/llm compares the operators with brute-force versions and the stages with what these decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import common as C
from shotloom.llm.bin_packing import pack
from shotloom.llm.decontaminate import contaminated
from shotloom.llm.quality_rules import quality_rules
from shotloom.llm.similarity_join import ngram_jaccard_join
from shotloom.llm.source_mixing import mix_sources


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality_rules(docs, C.table(spark, sf_dir, "labels"))
    return found.where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each component of near copies, rows without an id last.

    Texts are compared whatever their rows' ids, so rows with no id or a shared one are told apart by
    their texts (a 128-bit digest of both). Rows without words are copies of nothing and stay; only rows
    repeated under one id go. Of rows with equal id and text the least by the other columns stays.
    """
    key, pick = C.fresh(docs, "key"), C.fresh(docs, "pick")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), text).cast("binary")))
    keyed = docs.withColumn(key, own)
    found = ngram_jaccard_join(docs.select(own.alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    rows = keyed.groupBy("doc_id", key).agg(F.count("*").alias("times"))
    first = C.cut(rows.join(found, key).groupBy("component_id").agg(F.min_by(F.struct(key, "times"), order).alias("o")).select("o.*"))
    wordless = ~text.rlike(C.WORD)
    nameless = F.col("doc_id").isNull() & wordless
    # texts are shuffled only where rows are repeated
    once = keyed.where(~nameless).join(first.where("times = 1").select(key), key, "left_semi")
    repeated = keyed.where(~nameless).join(first.where("times > 1").select(key), key, "left_semi")
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c != "text"), F.col("text").isNull().alias("no_text")), {"ignoreNullFields": "false"})
    repeated = repeated.groupBy(key).agg(F.min_by(F.struct(*docs.columns), others).alias(pick)).select(f"{pick}.*")
    return once.select(*docs.columns).unionByName(repeated).unionByName(docs.where(nameless))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; rows without an id or with a shared one are judged by their own text."""
    own = C.fresh(docs, "digest")
    text = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = contaminated(docs.select(text.alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(own)).distinct()
    return docs.withColumn(own, text).join(found, own, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    taken = mix_sources(docs, carry=True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    return pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", one_of_each),
    ("decontaminate", drop_contaminated),
    ("source_mixing", mix),
    ("bin_packing", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = C.cut(stage(spark, docs, sf_dir))
    return docs
