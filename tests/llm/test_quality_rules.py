"""The log-likelihood ratio, its threshold and every verdict against a plain version with the same hashes."""

import random
import struct

import pytest
import xxhash

from shotloom.llm import quality_rules as Q
from tests.llm.test_llm import WORD, quality_counts


def hash_text(w, seed=42):
    return xxhash.xxh64_intdigest(w.encode(), seed)


def hash_long(x, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets_of(text, n):
    h = [hash_text(w) for w in WORD.findall(text or "")]
    return [signed(x) % n for x in h] + [signed(hash_long(signed(b), hash_long(signed(a), 42))) % n for a, b in zip(h, h[1:], strict=False)]


def test_against_brute_force(spark):
    import numpy as np

    r = random.Random(5)
    rows = [(i, " ".join(f"word{min(r.randrange(400), r.randrange(400))}" for _ in range(r.choice((30, 60, 90, 200))))) for i in range(160)]
    rows += [(500 + i, " ".join(f"word{r.randrange(400)}%%" for _ in range(80))) for i in range(40)]
    rows += [(700, None), (701, ""), (None, rows[0][1]), (3, rows[3][1]), (4, rows[170][1]), (702, "a b c " * 40)]
    labels = [(i, int(i % 7 > 0), 0) for i in range(140)] + [(None, 1, 0), (999, 1, 0), (5, 1, 0), (150, None, 0)]
    buckets, prior = 512, 1.5
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __r", "2 as __t", "3 as __m", "4 as score")
    got = Q.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=buckets, prior=prior).collect()
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    held = {i for i in trusted if signed(hash_long(i, hash_text("held"))) % Q.HELD == 0}
    raw, own = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        for b in buckets_of(t, buckets):
            raw[b] += 1
            own[b] += i in trusted - held
    share = (raw + 1) / (raw.sum() + buckets)
    ratio = np.log((own + prior * buckets * share) / (own.sum() + prior * buckets) / share)
    score = lambda t: float(np.mean(ratio[b])) if (b := buckets_of(t, buckets)) else 0.0
    threshold = np.percentile([score(t) for i, t in rows if i in held and quality_counts(t)[0] >= Q.MIN_WORDS], 100 * Q.QUANTILE) - Q.MARGIN
    assert len(got) == len(rows)
    want = {(i, t): (score(t), quality_counts(t)) for i, t in rows}
    for x in got:
        s, c = want[x.doc_id, x.text]
        assert x.score == pytest.approx(s, abs=1e-9)
        assert x.kept == (not (c[0] < 50 or 100 * c[4] > 50 * c[0]) and s >= threshold), (x.doc_id, s, threshold)
    assert {x.kept for x in got} == {True, False}


def test_helper_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", "b", "c")], "doc_id long, text string, ratios string, least string, measured string")
    row = Q.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()[0]
    assert (row["ratios"], row["least"], row["measured"]) == ("a", "b", "c") and row["n_words"] == 3
