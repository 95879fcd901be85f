"""The n-gram Jaccard join on shared and missing ids, salted lists and many seeds."""

import random

import numpy as np
import pytest

from shotloom.llm import similarity_join
from shotloom.llm.components import connected_components
from tests.llm.test_llm import groups_of, shingles, words

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(doc_id, set size, component_id) of every row: rows link by similarity and by a shared id."""
    sets = [shingles(t) for _, t in rows]
    links = []
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if sets[i] and sets[j] and (100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) or (a is not None and a == rows[j][0])):
                links.append((i, j))
    group = groups_of(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[group[i]] = min(doc, least.get(group[i], doc))
    return sorted(((d, len(sets[i]), least.get(group[i]) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def family(r, seed):
    """Near copies of some texts, at most similarities around the limit, over few boilerplate texts."""
    rows = []
    for g in range(r.randrange(2, 6)):
        base = words(r.randrange(12, 90), 1000 * seed + g, 3000)
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"x{r.randrange(50)}"
            rows.append((r.choice([None, *range(40)]), " ".join(own)))
    rows += [(r.randrange(40), r.choice(["", None, "a b", "A  b", " ".join(words(30, 5))]))for _ in range(6)]
    return rows


@pytest.mark.parametrize("salted", (False, True))
def test_many_seeds_against_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(similarity_join, "SALT_ROWS", 1)
        monkeypatch.setattr(similarity_join, "SALT_MEANS", 0)
    # seeds don't share words, so one run holds all of them: ids of a seed are its own
    rows, want = [], []
    for seed in range(10):
        own = [(None if d is None else d + 100 * seed, t and " ".join(f"s{seed}{w}" for w in t.split())) for d, t in family(random.Random(seed), seed)]
        rows += own
        want += brute(own)
    got = similarity_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == sorted(want, key=repr)


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(words(50, 900 + k, 5000)) for k in range(3))
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (None, b), (None, c), (3, ""), (5, None)]
    for parts in (1, 4):
        got = similarity_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
        assert sorted((tuple(x) for x in got), key=repr) == brute(rows)
    assert {x.component_id for x in got if x.doc_id in (5, 7, 9) and x.n_shingles} == {5}


def test_a_long_text_is_joined_whole(spark):
    base = words(120_000, 77, 200_000)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-900], *(f"y{i}" for i in range(900))])), (3, " ".join([*base[:60_000], *words(60_000, 78, 200_000)]))]
    got = {r.doc_id: r.component_id for r in similarity_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_fragments_cut_the_global_order(spark):
    common = " ".join(words(40, 3))
    rows = [(i, " ".join(words(60, 2000 + i, 9000)) + " " + common) for i in range(200)]
    order = similarity_join.global_order(spark.createDataFrame(rows, SCHEMA), 5, bits=18)
    grams = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2))
    part, level = order.fragment(grams), order.of(grams)
    by = np.lexsort((grams, level))
    assert (np.diff(part[by]) >= 0).all() and len(order.cuts) == similarity_join.FRAGMENTS - 1
    assert order.level.max() >= 4


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200, 300)] + [(400, 400 + i) for i in range(1, 50)] + [(1000 - i, 999 - i) for i in range(90)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups_of({x for p in links for x in p}, links)
