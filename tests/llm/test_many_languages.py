"""More languages than a fixed number, in the model and in one document."""

import random

import numpy as np
import pytest

from shotloom.llm import language_mixture


def test_every_label_is_learnt(spark):
    r = random.Random(8)
    own = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(230)}
    rows = [(1000 * i + k, " ".join(r.choices(words, k=30)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_mixture.train(df)
    assert langs == sorted(own) and table.shape == (language_mixture.CLASSES, 230)
    got = language_mixture.predict(df, langs, table, ["doc_id"]).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, _, x in rows}
    assert sum(x.lang_pred == lang[x.doc_id] for x in got) >= 0.99 * len(got)


def test_sets_of_more_than_four_languages():
    r = np.random.default_rng(2)
    words = r.normal(-30, 1, (600, 8))
    for k in range(6):
        words[100 * k : 100 * k + 100, k] += 12
    share = language_mixture.infer(words, np.array([0, 600, 600]))
    assert share[0] == pytest.approx([1 / 6] * 6 + [0, 0], abs=0.02) and not share[1].any()
