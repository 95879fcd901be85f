"""Mergeable quantile summaries (operator 11). DataFrame functions only.

Spark's own KLL aggregate summarises every batch of a group; the summary of a whole group is folded
from the batches' sketches alone. The sketches draw random bits, so each table of them is written
once and everything that follows reads that table: a lost executor can't mix two draws.

Exact ranks come from windows over the distinct values. A value belongs to the block of
2^BLOCK_BITS neighbouring integers that holds it; one window numbers the values inside a block, a
second adds up the blocks of a group. A block has at most 2^BLOCK_BITS distinct values however many
rows a group has, and repeated values are counted before the shuffle, so a group with a third of all
rows is dealt over as many tasks as it has blocks. Nothing is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Points kept at most; a sketch with this K keeps fewer than MOST_POINTS for groups of up to 8e13 rows.
MOST_POINTS = 2000
K = 600
PARTS = 20
BATCHES = 16
WHOLE = -1
BLOCK_BITS = 12
#: Millirank that an answer may be off.
ALLOWED = 10


def batch_summaries(rows: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, batch, sketch) from rows (keys, batch, x): one KLL sketch of the longs x for each batch of a group."""
    return C.cut(rows.groupBy(*keys, "batch").agg(F.kll_sketch_agg_bigint("x", F.lit(k)).alias("sketch")))


def merged(summaries: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, sketch): the batches' sketches of each group folded into one. Reads no rows."""
    return C.cut(summaries.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch")))


def answers(summaries: DataFrame, parts: int = PARTS, least: int = PARTS) -> DataFrame:
    """summaries with n, points (items that the sketch retains) and answers: its estimates at i / parts for i from 1 to parts - 1. Groups of under least rows are left out.

    The ranks asked for lie a hair below i / parts, so that a product that is rounded up doesn't ask for the next item.
    """
    kept = F.regexp_extract(F.kll_sketch_to_string_bigint("sketch"), r"Retained Items\s*:\s*(\d+)", 1).cast("long")
    ranks = F.array(*(F.lit(i / parts - 1e-12) for i in range(1, parts)))
    found = summaries.withColumn("n", F.kll_sketch_get_n_bigint("sketch")).where(F.col("n") >= least)
    return found.withColumns({"points": kept, "answers": F.kll_sketch_get_quantile_bigint("sketch", ranks)}).drop("sketch")


def exact_ranks(rows: DataFrame, asked: DataFrame, keys: list[str], parts: int = PARTS, least: int = PARTS) -> DataFrame:
    """(keys, batch, n, i, exact_x, points, answer, n_below, n_upto) for each group of asked.

    rows: (keys, batch, x); every row also counts for the whole of its group. asked: (keys, batch,
    points, answers) as of answers(). Answers are values that occur in their group.
    """
    key = [*keys, "batch"]
    # one long carries the places i of an answer as bits, and above them the points of its summary
    at = asked.select(*key, F.posexplode("answers").alias("i", "x"), F.shiftleft("points", parts).alias("p"))
    marks = at.select(*key, "x", F.lit(0).cast("long").alias("rows"), F.expr("p | shiftleft(1L, i + 1)").alias("mark"))
    each = rows.select(*keys, F.explode(F.array(F.col("batch"), F.lit(WHOLE))).alias("batch"), "x", F.lit(1).cast("long").alias("rows"), F.lit(0).cast("long").alias("mark"))
    values = each.unionByName(marks).groupBy(*key, "x").agg(F.sum("rows").alias("rows"), F.bit_or("mark").alias("mark")).withColumn("block", F.shiftright("x", BLOCK_BITS))
    group = Window.partitionBy(*key)
    before = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy(*key, "block").agg(F.sum("rows").alias("in_block"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0))).withColumn("n", F.sum("in_block").over(group)).where(F.col("n") >= least).drop("in_block")
    upto = F.sum("rows").over(Window.partitionBy(*key, "block").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).join(blocks.hint("merge"), [*key, "block"]).withColumn("upto", F.col("upto") + F.col("before"))
    ranked = ranked.withColumn("below", F.col("upto") - F.col("rows"))
    # the ceil(i * n / parts)-th smallest value is this one for the i from first to last
    ranked = ranked.withColumns({"first": F.expr(f"({parts} * below) div n + 1"), "last": F.expr(f"({parts} * upto) div n")})
    hits = ranked.where(f"mark <> 0 OR (first <= last AND first < {parts})")
    hits = hits.select(*key, "n", "x", "below", "upto", "mark", "first", "last", F.explode(F.array(*map(F.lit, range(1, parts)))).alias("i"))
    exact, answer = F.expr("i BETWEEN first AND last"), F.expr("(shiftright(mark, i) & 1) = 1")
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    return hits.where(exact | answer).groupBy(*key, "n", "i").agg(
        pick(exact, "x").alias("exact_x"),
        pick(answer, "x").alias("answer"),
        pick(answer, "below").alias("n_below"),
        pick(answer, "upto").alias("n_upto"),
        F.shiftright(F.max("mark"), parts).alias("points"),
    )


def quantile_summaries(rows: DataFrame, keys: list[str], k: int = K, parts: int = PARTS) -> DataFrame:
    """(keys, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within) for every batch of every group, and as batch -1 for the whole of it.

    rows: (keys, batch int from 0, x long). Rows with a null key, batch or x are left out; extra
    columns are ignored. Repeated rows count as often as they occur, ties of x count together.
    Groups of fewer than parts rows have no lines; an empty table gives an empty result.
    """
    rows = rows.select(*keys, "batch", "x").dropna()
    own = batch_summaries(rows, keys, k)
    whole = merged(own, keys, k).withColumn("batch", F.lit(WHOLE))
    asked = C.cut(answers(own.unionByName(whole), parts))
    found = exact_ranks(rows, asked, keys, parts).withColumn("target", F.expr(f"(i * n + {parts - 1}) div {parts}"))
    found = found.withColumn("rank_error", F.greatest(F.lit(0).cast("long"), F.expr("n_below + 1 - target"), F.expr("target - n_upto")))
    return found.withColumn("within", F.expr(f"1000 * rank_error <= {ALLOWED} * n"))


def measured(table: DataFrame, stream: int, grp: str, id_: str, money: str) -> DataFrame:
    """(stream, grp, batch, x) of the rows with a group and a finite amount of money. A row without an id is of batch 0."""
    own = F.col(money)
    batch = (F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % BATCHES).cast("int")
    whole = own.isNotNull() & ~F.isnan(own) & (F.abs(own) < 1e15) & F.col(grp).isNotNull()
    rows = table.where(whole).select(F.lit(stream).cast("tinyint").alias("stream"), F.col(grp).cast("string").alias("grp"), batch.alias("batch"), own.alias("m"))
    return rows.select("stream", "grp", "batch", (F.floor(F.lit(100) * F.col("m") + 0.5) + 1000 * F.col("batch")).cast("long").alias("x"))


def op11_quantile_summaries(spark, sf_dir):
    """clicks by client and the prices of sale_lines by brand. Of rows that share a click_id the least client and value counts; clicks without an id are all different."""
    clicks = C.table(spark, sf_dir, "clicks").select("click_id", "client_id", "value").where("client_id IS NOT NULL AND value IS NOT NULL")
    once = clicks.where("click_id IS NOT NULL").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("c")).select("click_id", "c.*")
    clicks = once.unionByName(clicks.where("click_id IS NULL"))
    items = C.table(spark, sf_dir, "items").where("brand IS NOT NULL AND price IS NOT NULL AND item_id IS NOT NULL").select("item_id", "brand", "price")
    lines = C.table(spark, sf_dir, "sale_lines").select("item_id", "vendor_id").join(items.hint("merge"), "item_id")
    rows = C.cut(measured(clicks, 0, "client_id", "click_id", "value").unionByName(measured(lines, 1, "brand", "vendor_id", "price")))
    found = quantile_summaries(rows, ["stream", "grp"])
    name = F.when(F.col("stream") == 0, "value").otherwise("price").alias("stream")
    return found.select(name, "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")
