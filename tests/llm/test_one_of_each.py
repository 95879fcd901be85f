"""The pipeline's near-copy stage on rows with no id and with shared ids."""

import corpus_pipeline as P
from tests.llm.test_llm import words


def test_rows_are_told_apart_by_their_texts(spark):
    a, b, c, d = (" ".join(words(60, 700 + k, 5000)) for k in range(4))
    rows = [(1, a), (1, b), (2, a + " end"), (3, a), (None, c), (None, c), (None, c + " end"), (None, d), (4, d), (1, a), (5, None), (6, None), (6, None), (7, " "), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as n")
    out = P.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    ones = [x for x in got if x[1] in (c, c + " end") and x[0] is None]
    assert len(ones) == 1
    assert [x for x in got if x not in ones] == sorted([(1, a), (1, b), (4, d), (5, None), (6, None), (7, " "), (None, "")], key=repr)


def plain(rows):
    """The rows that stay, by brute force over all pairs of texts."""
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))((t or "").lower().split())
    nodes = sorted({(r[0], r[1] or "") for r in rows}, key=repr)
    sets, up = [grams(t) for _, t in nodes], list(range(len(nodes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[root(i)] = root(j)
    parts = {}
    for i, (doc, text) in enumerate(nodes):
        parts.setdefault(root(i), []).append((doc, text))
    kept = []
    for own in parts.values():
        have = [x for x in own if x[0] is not None]
        kept.append((min(x[0] for x in have) if have else None, {x[1] for x in own if not have or x[0] == min(y[0] for y in have)}))
    return kept


def test_against_brute_force_whatever_the_partitions(spark):
    import random

    r = random.Random(11)
    base = [words(40, 50 + k, 3000) for k in range(12)]
    texts = []
    for k in range(120):
        own = list(r.choice(base))
        for _ in range(r.randrange(4)):
            own[r.randrange(40)] = f"w{r.randrange(1000)}"
        texts.append(" ".join(own))
    rows = [(r.choice((k, None)) if k % 9 == 0 else k, t, r.choice(("web", "code"))) for k, t in enumerate(texts)]
    rows += [(rows[k][0], rows[k][1], s) for k in (3, 5, 8) for s in ("web", "code", "zine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = [sorted((tuple(x) for x in P.one_of_each(spark, docs.repartition(n), "").collect()), key=repr) for n in (1, 5)]
    assert out[0] == out[1]
    assert P.one_of_each(spark, docs, "").columns == docs.columns
    want = plain(rows)
    assert len(out[0]) == len(want)
    left = list(want)
    for doc, text, source in out[0]:
        fit = next(w for w in left if w[0] == doc and text in w[1])
        left.remove(fit)
        equal = [x[2] for x in rows if x[:2] == (doc, text)]
        assert source == min(equal, key=lambda x: (x is None, x or ""))  # by their JSON, so null is last


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert P.one_of_each(spark, docs, "").collect() == []
    assert P.drop_contaminated(spark, docs, "/root/testdata/sf0.001").collect() == []
