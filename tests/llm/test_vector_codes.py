"""Vector codes against exact integer loops."""

import random

import numpy as np
import pytest

from shotloom.llm import vector_codes as V


def plain(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) and abs(x) <= V.LARGEST for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[int(np.floor(float(np.float32(x)) * 1024)) for x in r[1]] for r in kept]
    cuts = V.edges(len(whole[0]), parts)
    books = [[w[a:b] for w in whole[:entries]] for a, b in cuts]
    near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            at = [near(w[a:b], books[k])[1] for w in whole]
            for e in set(at):
                own = [w[a:b] for w, i in zip(whole, at, strict=True) if i == e]
                books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for r, w in zip(kept, whole, strict=True):
        found = [near(w[a:b], books[k]) for k, (a, b) in enumerate(cuts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, ",".join(str(v) for b in books for c in b for v in c)


@pytest.mark.parametrize(("dim", "entries", "step"), [(8, 6, 0.25), (7, 5, 0.01), (3, 40, 0.5), (8, 200, 100.0)])
def test_equal_to_integer_loops(spark, dim, entries, step):
    r = random.Random(dim)
    vec = lambda: [step * r.randrange(-6, 7) for _ in range(dim)]  # noqa: E731  a coarse grid has many ties
    rows = [(r.choice((i, i // 3)), vec(), r.choice((1, 2, None))) for i in range(150)]
    rows += [(None, vec(), 1), (3, None, 1), (4, [None] + vec()[1:], 2), (5, [float("nan")] + vec()[1:], 2), (6, [float("inf")] + vec()[1:], 2), (7, [], 1), (8, vec() + [1.0], 1), (9, [1e6] * dim, 1)]
    rows += [rows[0]] * 20
    r.shuffle(rows)
    table = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    codes, books = V.vector_codes(table, entries=entries, rounds=3)
    want, text = plain(rows, 4, entries, 3)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in codes.select("vec_id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert books.text() == text
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert all(x.label_error == sums[x.label] for x in V.with_label_error(codes).collect())


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(V, "FEW_LABELS", 0)
    table = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.5, 2.0], i % 3 or None) for i in range(50)], "vec_id long, embedding array<float>, label int")
    assert V.with_label_error(V.vector_codes(table, entries=2)[0]).count() == 50


def test_no_whole_vector(spark):
    codes, books = V.vector_codes(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert codes.collect() == [] and books is None


def test_screening_never_misses_a_near_tie():
    g = np.random.default_rng(5)
    book = g.integers(-(1 << 20), 1 << 20, (256, 16))
    x = book[g.integers(0, 256, 3000)] + book[g.integers(0, 256, 3000)] >> 1  # half way between two entries
    book[100:200] = book[:100] + g.integers(0, 2, (100, 16))
    at, error = V.nearest(x, book)
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (error == d.min(1)).all()


def test_against_its_sql(spark):
    from shotloom.llm import registry
    from tests.compare import compare, connect

    path, name = "/root/testdata/sf0.001", "op13_vector_codes"
    assert compare(spark, connect(path), path, name, registry.QUERIES[name], registry.ORACLES[name]) is None
