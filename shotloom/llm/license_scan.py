"""License scans by diagonal voting (operator 9). DataFrame functions only.

Every rolling k-gram of a document's words is hashed and joined to the positions of the same k-gram
in the templates. A hit votes for the diagonal (place in the document minus place in the template).
Votes are summed per diagonal, and diagonals at most `gap` apart are one span (a few words put in or
left out), which drifts by no more than the template's length. A span is verified word by word:
a hit counts only if the words themselves are equal, and these must cover a share of the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .license_texts import TEXTS
from .quality_rules import let

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = TEXTS
#: Template k-grams are broadcast up to this number; beyond it the join shuffles.
BROADCAST_GRAMS = 200_000


def license_words(text):
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), NOT_WORD), "")


def _grams(words, k: int):
    """(hash, the words w0, w1, ...) of every k-gram."""

    def body(w, i):
        own = [w, *(F.get(words, i + j) for j in range(1, k))]
        return F.struct(F.xxhash64(*own).alias("gram"), *(x.alias(f"w{j}") for j, x in enumerate(own)))

    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))), body)


def _places(words, phrase: str):
    parts = phrase.split()
    here = lambda w, i: F.when(_all(w, i, words, parts), i)
    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _all(w, i, words, parts):
    """The rarest word is the last; it is tested first, so most places cost one comparison."""
    n = len(parts) - 1
    same = w == parts[-1]
    for j in range(n):
        same = same & (i >= n) & (F.get(words, F.greatest(i - (n - j), F.lit(0))) == parts[j])
    return same


def _earlier(places, by: int):
    return F.transform(places, lambda i: i - by)


def template_table(spark, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """(template, label, length, place, gram) of every k-gram of the templates (label, text); gram is a struct of hash and words."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    own = rows.withColumn("words", license_words(F.col("text")))
    return own.select("template", "label", F.size("words").alias("length"), F.posexplode(let(F.col("words"), lambda w: _grams(w, k))).alias("place", "own"))


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = 3, gap: int = 2, least: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, label, start_word, end_word, covered) of every verified span.

    Repeated rows give their spans once; null and empty texts give none.
    """
    known = template_table(docs.sparkSession, templates, k)
    few = sum(len(text.split()) for _, text in templates) <= BROADCAST_GRAMS
    grams = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(let(license_words(F.col("text")), lambda w: _grams(w, k))).alias("at", "x"))
    same = F.col("x.gram") == F.col("own.gram")
    for j in range(k):
        same = same & (F.col(f"x.w{j}") == F.col(f"own.w{j}"))
    hits = grams.join(F.broadcast(known) if few else known, same)
    place = ["doc_id", "text_hash", "template", "label", "length"]
    votes = hits.groupBy(*place, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    own = Window.partitionBy(*place).orderBy("diagonal")
    merged = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(own) > gap).cast("int")).withColumn("chain", F.sum("new").over(own))
    drift = F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*place, "chain"))) / F.col("length"))
    spans = merged.withColumn("drift", drift).groupBy(*place, "chain", "drift").agg(F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("start_word"), (F.max("last") + k - 1).alias("end_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    return spans.select("doc_id", "text_hash", "label", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), (covered / F.col("length")).alias("covered")).where(F.col("covered") >= least)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=None, k: int = 3, gap: int = 2, least: float = 0.8) -> DataFrame:
    """For every row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrases count wherever their words stand consecutively, overlapping places too. labels adds the
    method's to the phrases' own. score is the best covered share of a template, and 1 with a
    phrase. Null and empty texts have no words, no labels (empty strings), score 0. Rows that
    share doc_id and text share labels; a null doc_id is a value like others. Extra columns are ignored.
    """
    phrases = phrases or PHRASES

    def base(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), *(_places(w, p).alias(f"p{i}") for i, p in enumerate(phrases)))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(license_words(F.col("text")), base).alias("b"))
    starts = F.concat(*(_earlier(F.col(f"b.p{i}"), len(p.split()) - 1) for i, p in enumerate(phrases)))
    named = F.array_compact(F.array(*(F.when(F.size(f"b.p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    rows = rows.select("doc_id", "text_hash", "b.n_words", starts.alias("starts"), F.array_sort(F.array_distinct(named)).alias("base"))
    found = license_spans(docs, templates, k, gap, least).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(F.collect_set("label").alias("more"), F.max("covered").alias("best"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
    )


def op9_license_scan(spark, sf_dir):
    return license_scan(C.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    texts = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
    split = lambda x: f"list_filter(regexp_split_to_array(translate(coalesce({x}, ''), '{UPPER}', '{LOWERED}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    place = lambda p: f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()!r})"
    starts = " || ".join(place(p) for p in PHRASES)
    bases = " || ".join(f"CASE WHEN len({place(p)}) > 0 THEN ['{label}'] ELSE [] END" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split('text')} AS w FROM documents),
b AS (SELECT r, doc_id, len(w) AS n_words, {starts} AS starts, list_sort(list_distinct({bases})) AS base FROM d),
t AS (SELECT template, label, {split('text')} AS w FROM (VALUES {texts}) AS v(template, label, text)),
tg AS (SELECT template, label, len(w) AS length, i AS place, array_to_string(w[i + 1:i + 3], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM t)),
dg AS (SELECT r, i AS pos, array_to_string(w[i + 1:i + 3], ' ') AS gram FROM (SELECT r, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d)),
h AS (SELECT r, template, label, length, place, pos - place AS diagonal FROM dg JOIN tg USING (gram)),
v AS (SELECT DISTINCT r, template, label, length, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS new FROM v),
c AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS chain FROM n),
f AS (SELECT *, floor((diagonal - min(diagonal) OVER (PARTITION BY r, template, chain)) / length) AS drift FROM c),
p AS (SELECT f.r, f.template, f.label, f.length, chain, drift, unnest([place, place + 1, place + 2]) AS word FROM f JOIN h ON f.r = h.r AND f.template = h.template AND f.diagonal = h.diagonal),
s AS (SELECT r, label, count(DISTINCT word) / length::DOUBLE AS covered FROM p GROUP BY r, template, label, length, chain, drift),
m AS (SELECT r, list(DISTINCT label) AS more, max(covered) AS best FROM s WHERE covered >= 0.8 GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(starts)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, coalesce(best, 0::DOUBLE)) END AS score
FROM b LEFT JOIN m ON b.r = m.r"""


ORACLE = _oracle()
