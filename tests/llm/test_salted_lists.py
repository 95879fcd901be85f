"""Posting lists whose few classes fall into different salts."""

from shotloom.llm import similarity_join
from tests.llm.test_llm import brute_components, words


def test_classes_alone_in_their_salts_stay_linked(spark, monkeypatch):
    monkeypatch.setattr(similarity_join, "SALT_ROWS", 3)
    rows = []
    for g in range(30):
        base = words(60, 500 + g, 5000)
        rows += [(100 * g + i, " ".join(base)) for i in range(8)]
        rows.append((100 * g + 50, " ".join([*base[:-1], f"edit{g}"])))
    want = brute_components(rows)
    assert all(want[100 * g + 50] == want[100 * g] for g in range(30))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similarity_join.ngram_jaccard_join(df).collect()} == want
