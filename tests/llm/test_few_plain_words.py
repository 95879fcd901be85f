"""Benchmark items with few words that are no numbers, names or units."""

from shotloom.llm import decontaminate


def test_verbatim_copies_of_items_with_few_plain_words_are_found(spark):
    short, digits = "What is 48 times 17?", "12 15 18 21 24 27 30 33 36 39 42 45"
    mixed = "A train leaves the station at noon and passes 3 6 9 12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60"
    items = spark.createDataFrame([(1, short), (2, digits), (3, "48 miles"), (4, mixed)], "item_id long, text string")
    rows = [(1, "Now: what is 48 times 17? Say."), (2, "What is 48 times 18?"), (3, f"Next come {digits} and so on"), (4, "1 5 8 1 4 7 0 3 6 9 2 5"), (5, "some 48 miles"), (6, "some 49 miles"), (7, mixed), (8, mixed.replace("3 6 9", "4 7 1"))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (7, 2), (7, 4), (8, 2), (8, 4)}
    assert all(got[k].coverage == 1 and got[k].n_changed == 0 for k in ((1, 1), (3, 2), (5, 3), (7, 2), (7, 4)))
    assert got[8, 4].n_changed > 0
