"""Token counts of very long texts, of fields, and of odd rows."""

import collections

import pytest

from shotloom.llm import token_counts as T


def test_very_long_texts_are_encoded_as_a_whole(spark):
    encoding, width = T.load_encoding(T.default_vocabulary())
    texts = ["漢字かな" * 300_000, "12345 " * 250_000, "abc def\n" * 180_000, "9" * 1_200_000, "word" * 300_000]
    got = {x.doc_id: x.doc_tokens for x in T.attribute_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sections=lambda d: [0, len(d)]).collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_long_blank_runs_give_the_tokens_of_the_whole():
    encoding, width = T.load_encoding(T.default_vocabulary())
    for run in (" " * 700, "\n" * 900, "\t \n" * 400, " \xa0 " * 300, "\r\n" * 600):
        for text in (run, "a" + run, run + "b", f"x,{run}é {run}5{run}!", run + "\x1c" + run):
            assert list(T._encode(encoding, text)) == encoding.encode_ordinary(text)
    for text in (" " * 1_500_000, "a" + "\n" * 1_500_000 + "b", "!" * 1_500_000):
        assert width[T._encode(encoding, text)].sum() == len(text)


@pytest.mark.parametrize("rule", T.RULES)
def test_fields(spark, rule):
    rows = [(1, "A title", "the body of it", None), (1, "other", "", "x"), (None, None, None, None), (2, "naïve café", "\n\n  b", "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, url string").selectExpr("*", "1 as section", "2 as field")
    got = T.attribute_fields(docs, ["title", "body", "url"], rule).collect()
    assert len(got) == 12 and [x.field for x in got[:3]] == ["title", "body", "url"]
    encoding, _ = T.load_encoding(T.default_vocabulary())
    counts = collections.Counter()
    for x in got:
        counts[x.doc_id, x.doc_tokens] += x.n_tokens
    want = {(r[0], n): n for r in rows for n in [len(encoding.encode_ordinary("\n".join(v or "" for v in r[1:])))]}
    assert counts == pytest.approx(want)
    title = next(x for x in got if x.doc_id == 2)
    assert (title.start_char, title.end_char) == (0, len("naïve café\n"))


def test_rows_without_an_id_or_with_a_shared_one(spark):
    rows = [(None, "a b"), (None, None), (3, "one\ntwo"), (3, "three"), (3, "three"), (4, "")]
    got = sorted(((x.doc_id, x.section, x.n_tokens) for x in T.attribute_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert len(got) == 7 and got.count((3, 0, 1.0)) == 2 and (None, 0, 0.0) in got and (4, 0, 0.0) in got


def test_nothing(spark):
    assert T.attribute_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
