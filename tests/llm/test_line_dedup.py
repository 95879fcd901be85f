"""Line dedup against a plain version; the perfect hash on its own."""

import random

import numpy as np
import pytest

from shotloom.llm import line_dedup as L

BLANK = " \t\n\v\f\r"


def plain(texts, least_docs=10, least_chars=1):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    lines = [(t or "").split("\n") for t in texts]
    seen = {}
    for own in lines:
        for k in {key(x) for x in own}:
            seen[k] = seen.get(k, 0) + 1
    gone = {k for k, n in seen.items() if n >= least_docs and len(k) >= max(1, least_chars)}
    kept = [[x for x in own if key(x) not in gone] for own in lines]
    return sorted((len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(lines, kept, strict=True))


def texts_of(seed):
    r = random.Random(seed)
    common = ["Read more", " read MORE\t", "ÉTÉ", "été", "© 2024", "x", "", " ", "\v", "a" * 3000] + [f"line {i}" for i in range(40)]
    made = ["\n".join(r.choice(common + [f"own {r.random()}"] * 5) for _ in range(r.randrange(0, 30))) for _ in range(300)]
    return made + [None, "", "\n", "\n\n", " \n", "read more", "read more\n", "\nread more"] + [made[0]] * 9


@pytest.mark.parametrize("room", [L.ARRAY_BYTES, 12 * L.LINE_BYTES, 1])
def test_near_and_far_arrays_equal_the_plain_version(spark, monkeypatch, room):
    monkeypatch.setattr(L, "SHARD", 7)
    monkeypatch.setattr(L, "PROBES", 500)
    texts = texts_of(room)
    docs = spark.createDataFrame([(i % 200 if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    got = L.drop_repeated_lines(docs, array_bytes=room).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == plain(texts)
    assert sorted(r.doc_id or -1 for r in got) == sorted((i % 200 if i % 7 else None) or -1 for i in range(len(texts)))


def test_short_keys_stay(spark):
    texts = texts_of(3)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = L.drop_repeated_lines(docs, least_docs=4, least_chars=3).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == plain(texts, 4, 3)


def test_empty_table(spark):
    assert L.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_hash_is_perfect_minimal_and_rejects_others(n):
    g = np.random.default_rng(n)
    digests = g.integers(0, 2**63, (n, 2), dtype=np.uint64)
    if n > 2:
        digests[1, 0] = digests[0, 0]  # half of a digest may be shared
    shard = L.Shard.build(digests, np.arange(n) + 1)
    assert (shard.find(digests) == np.arange(n) + 1).all()
    assert len(shard.counts) == n and int(np.bitwise_count(shard.places).sum()) == n
    assert len(shard.places) * 64 <= 6 * n + 64 * 30
    assert not shard.find(g.integers(0, 2**63, (1000, 2), dtype=np.uint64)).any()


def test_against_its_sql(spark):
    from shotloom.llm import registry
    from tests.compare import compare, connect

    path, name = "/root/testdata/sf0.001", "op12_line_dedup"
    assert compare(spark, connect(path), path, name, registry.QUERIES[name], registry.ORACLES[name]) is None
