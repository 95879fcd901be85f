"""Long texts piece by piece, held-out accuracy, and a plain mixture model."""

import numpy as np
import pytest

from shotloom.llm import language_mixture as L


def test_pieces_give_what_the_whole_gives():
    r = np.random.default_rng(4)
    for langs in (1, 3, 12):
        words = r.normal(-30, 3, (5000, langs))
        words[:3000, 0] += 10
        words[3000:, langs // 2] += 10
        pieces = lambda: (words[k : k + 700] for k in range(0, 5000, 700))
        assert L.infer_long(pieces, 5000, langs) == pytest.approx(L.infer(words, np.array([0, 5000]))[0], abs=1e-9)


def test_long_texts_in_the_operator(spark, monkeypatch):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    whole = {x.doc_id: (x.lang_pred, x.langs, x.score) for x in L.identify_languages(docs).collect()}
    monkeypatch.setattr(L, "SCORES", 64)
    cut = {x.doc_id: (x.lang_pred, x.langs, x.score) for x in L.identify_languages(docs).collect()}
    assert {k: v[:2] for k, v in cut.items()} == {k: v[:2] for k, v in whole.items()}
    assert all(cut[k][2] == pytest.approx(whole[k][2], abs=1e-6) for k in whole)


def test_against_a_plain_mixture():
    """Proportions of the likeliest set of two languages, by word-by-word expectation-maximisation."""
    r = np.random.default_rng(9)
    words = r.normal(-20, 1, (300, 4))
    words[:180, 1] += 9
    words[180:, 3] += 9
    share = {1: 0.5, 3: 0.5}
    for _ in range(40):
        total = dict.fromkeys(share, 0.0)
        for w in words:
            part = {k: share[k] * np.exp(w[k] - w.max()) for k in share}
            for k in share:
                total[k] += part[k] / sum(part.values())
        share = {k: v / len(words) for k, v in total.items()}
    got = L.infer(words, np.array([0, 300]))[0]
    assert got[[0, 2]].tolist() == [0, 0] and got[1] == pytest.approx(share[1], abs=1e-3) and got[3] == pytest.approx(share[3], abs=1e-3)


def test_odd_rows(spark):
    rows = [(None, "the word and the others of it", "en"), (None, None, None), (1, "der die das und nicht", "de"), (1, "the word of it", "en"), (1, "the word of it", "en"), (2, " \n", None), (3, "ж" * 400_000, None)]
    got = L.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score", "true as held_out")).collect()
    assert len(got) == len(rows) and {x.lang_pred for x in got} <= {"en", "de", "und"}
    assert sum(x.held_out for x in got if x.doc_id is None) == 0 and sum(x.lang_pred == "und" for x in got) == 2
