"""The pipeline's stages on repeated rows, rows without an id and shared ids, against what their operators decide."""

import collections

import corpus_pipeline as P
from shotloom.llm import bin_packing, quality_rules, source_mixing
from tests.llm.test_llm import words

PATH = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def odd(spark):
    own = spark.read.parquet(f"{PATH}/documents.parquet")
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").orderBy("item_id").first().text
    text = " ".join(words(90, 31, 4000))
    rows = [(None, text, "en", None, 1), (None, item, "en", "web", 1), (7, "other " + text, "en", "web", 1), (7, f"{text} {item}", None, "web", None), (7, None, "en", None, 1), (8, text, "x", "web", 1), (8, text, "x", "web", 1)]
    return own.limit(40).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*own.columns))


def test_quality_keeps_what_the_operator_keeps(spark):
    docs = odd(spark)
    kept = quality_rules.quality_rules(docs, P.C.table(spark, PATH, "labels")).where("kept").select(*docs.columns)
    assert rows_of(P.keep_quality(spark, docs, PATH)) == rows_of(kept)


def test_contaminated_rows_go_whatever_their_ids(spark):
    docs = odd(spark)
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").orderBy("item_id").first().text
    out = rows_of(P.drop_contaminated(spark, docs, PATH))
    assert not any(r[1] and item in r[1] for r in out)
    gone = rows_of(docs) - out
    assert all(r[1] for r in gone) and sum(out.values()) + sum(gone.values()) == docs.count()
    assert (7, None) in {r[:2] for r in out} and (None,) in {r[:1] for r in out}


def test_mix_repeats_each_row_as_often_as_taken(spark):
    docs = odd(spark)
    taken = collections.Counter()
    for r in source_mixing.mix_sources(docs, carry=True).collect():
        taken[tuple(r.row)] += r.copies
    assert rows_of(P.mix(spark, docs, PATH)) == +taken


def test_shards_are_those_of_the_operator(spark):
    docs = odd(spark)
    assert rows_of(P.shard(spark, docs, PATH)) == rows_of(bin_packing.pack(docs))
