"""The licence scan against its SQL, on moved words, foreign words, repeated notices and odd rows."""

from shotloom.llm import license_scan, license_texts, registry
from tests.compare import compare, connect


def scan(spark, rows, **how):
    return license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as gram", "3 as starts"), **how).collect()


def test_against_its_sql(spark):
    path, name = "/root/testdata/sf0.001", "op9_license_scan"
    assert compare(spark, connect(path), path, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_every_template_is_found_and_altered_ones_are_measured(spark):
    rows = [(i, f"Some code here. {text} More code.") for i, (_, text) in enumerate(license_texts.TEXTS)]
    for x in scan(spark, rows):
        assert license_texts.TEXTS[x.doc_id][0] in x.labels.split(",") and x.score == 1
    own = license_texts.TEXTS[2][1].split()
    some = [(0, " ".join([*own[:30], "really", "quite", *own[30:]])), (1, " ".join(own[:25])), (2, " ".join(w for k, w in enumerate(own) if k % 4)), (3, " ".join(reversed(own)))]
    got = {x.doc_id: x for x in scan(spark, some, templates=(("mit", license_texts.TEXTS[2][1]),))}
    assert got[0].labels == "mit" and 0.9 < got[0].score <= 1
    assert [got[i].labels for i in (1, 2, 3)] == ["", "", ""]


def test_repeated_notices_are_spans_of_their_own(spark):
    text = " x ".join(["this is free and unencumbered software released into the public domain"] * 300)
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text)], "doc_id long, text string")
    spans = license_scan.license_spans(docs).where("doc_id = 1").collect()
    assert len(spans) == 300 and all(x.end_word - x.start_word == 10 and x.covered == 1 for x in spans)


def test_odd_rows(spark):
    rows = [(None, "cc by"), (None, None), (1, "All rights reserved"), (1, "nothing"), (1, "nothing"), (2, ""), (3, "é CC-BY ünï all Rights reserved " + "w " * 200_000)]
    got = scan(spark, rows)
    assert len(got) == len(rows)
    by = sorted(((x.doc_id, x.n_words, x.n_base, x.labels) for x in got), key=repr)
    assert by == sorted([(None, 2, 1, "cc-by"), (None, 0, 0, ""), (1, 3, 1, "reserved"), (1, 1, 0, ""), (1, 1, 0, ""), (2, 0, 0, ""), (3, 200_007, 2, "cc-by,reserved")], key=repr)
