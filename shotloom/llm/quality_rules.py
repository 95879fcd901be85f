"""Quality rules with a hashed n-gram log-likelihood ratio (operator 7). DataFrame functions only.

Words and word pairs are hashed to a fixed number of buckets. One multinomial is counted over all
documents, one over trusted documents (labels of quality 1). A document's score is the mean over
its n-grams of log(trusted / raw). The trusted multinomial is shrunk towards the raw one.

Trusted documents that were counted score higher than equally clean ones that were not. So one in
HELD of them is not counted; the threshold is a low quantile of these documents' scores, less a
margin. It is one number for the corpus and the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Buckets of both multinomials; their ratios are one array of this many doubles.
BUCKETS = 1 << 16
#: Most trusted documents that the target multinomial is fitted on, chosen by hash of doc_id.
TRUSTED = 20_000
#: Weight of the raw multinomial in the trusted one, in n-grams a bucket.
PRIOR = 10.0
#: One in so many trusted documents sets the threshold instead of being counted.
HELD = 5
#: The threshold is this quantile of their scores, less the margin.
QUANTILE, MARGIN = 0.005, 0.015
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def let(value, body):
    """Evaluates value once and hands it to body as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text):
    """64-bit hash of every word; what follows works on these, so each word's text is read once."""
    return F.transform(C.words_of(text), lambda w: F.xxhash64(w))


def ngram_buckets(hashes, buckets: int = BUCKETS):
    """Bucket of every word and of every pair of neighbouring words."""
    n = F.size(hashes)
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)))
    two = F.transform(F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)))
    return F.concat(one, two)


def repeated_words(hashes):
    """Words in windows of three that occur twice or more, all occurrences counted."""
    n = F.size(hashes)
    windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def places(found):
        order = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        own = let(order, lambda o: F.filter(F.transform(o, lambda x, k: F.when((x["h"] == F.get(o, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(o, F.greatest(k - 1, F.lit(0)))["h"])), x["i"])), lambda i: i.isNotNull()))
        return let(F.array_sort(own), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places(h))))


def duplicate_lines(text):
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(C.WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _trusted(labels: DataFrame, most: int) -> DataFrame:
    """At most so many trusted ids, with held on those that set the threshold."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return ids.select("doc_id", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0).alias("held"))


def log_ratios(docs: DataFrame, ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with the array of log(trusted / raw) for each bucket; raw counts cover all documents. ids: (doc_id, held), of bounded size."""
    grams = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select((~F.coalesce("held", F.lit(True))).alias("own"), F.explode(let(word_hashes(F.col("text")), lambda h: ngram_buckets(h, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("own").alias("own"))
    every = docs.sparkSession.range(0, buckets, 1, 1).withColumnRenamed("id", "bucket")
    counts = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("own", F.lit(0)).alias("own"))
    rows = counts.agg(F.sum("raw").alias("n_raw"), F.sum("own").alias("n_own"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "own"))).alias("all"))
    share = lambda x: (x["raw"] + 1.0) / (F.col("n_raw") + buckets)
    ratio = lambda x: F.log((x["own"] + prior * buckets * share(x)) / (F.col("n_own") + prior * buckets) / share(x))
    return rows.select(F.transform("all", ratio).alias("ratios"))


def _mean_ratio(hashes, table, buckets: int):
    return let(ngram_buckets(hashes, buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int"))) / F.greatest(F.size(g), F.lit(1)))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """Every row of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Null, empty and blank texts have no words: all counts but the symbols of blank texts are 0, the
    base fails and score is 0. Without a trusted document to set the threshold, the base alone
    decides. Labels of quality null or 0 and labels without a document are ignored; repeated rows
    count as often as they occur. Extra columns of docs stay unless an output name clashes, which
    is replaced. Very long texts are scored whole.
    """
    ids = C.cut(_trusted(labels, trusted))
    ratios = C.cut(log_ratios(docs, ids, buckets, prior))
    held_r, held_t, held_m = (C.fresh(docs, c) for c in ("ratios", "least", "measured"))
    table = F.col(held_r)  # a scalar subquery's value: each executor holds it once
    held = docs.select("doc_id", "text").join(F.broadcast(ids.where("held")), "doc_id", "left_semi").withColumn(held_r, ratios.scalar())
    held = held.select(let(word_hashes(F.col("text")), lambda h: F.when(F.size(h) >= MIN_WORDS, _mean_ratio(h, table, buckets))).alias("score"))
    threshold = C.cut(held.agg((F.percentile("score", QUANTILE) - MARGIN).alias("threshold")))
    text = F.coalesce(F.col("text"), F.lit(""))
    least = F.coalesce(F.col(held_t), F.lit(float("-inf")))

    def measure(h):
        """One struct, decision included, so that a filter on it evaluates it once."""
        n = F.size(h).cast("long")
        failed = lambda r: (n < MIN_WORDS) | (100 * r > 50 * n)
        whole = lambda r, s: F.struct(n.alias("n_words"), r.alias("n_repeat_words"), failed(r).alias("base_failed"), s.alias("score"), (~failed(r) & (s >= least)).alias("kept"))
        return let(repeated_words(h), lambda r: let(_mean_ratio(h, table, buckets), lambda s: whole(r, s)))

    found = docs.withColumns({held_r: ratios.scalar(), held_t: threshold.scalar()}).withColumn(held_m, let(word_hashes(F.col("text")), measure))
    return found.withColumns({
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        **{c: F.col(f"{held_m}.{c}") for c in ("n_words", "n_repeat_words", "base_failed", "score", "kept")},
    }).drop(held_m, held_r, held_t)


def op7_quality_rules(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules(docs, C.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
