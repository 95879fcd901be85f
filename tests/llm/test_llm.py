"""Operators against brute-force versions, and on nulls, empty tables, ties and clashing columns."""

import collections
import os
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from shotloom.llm import bin_packing, decontaminate, language_mixture, license_scan, pseudonyms, quality_rules, similarity_join, source_mixing, token_counts, url_filters  # noqa: E402
from shotloom.llm.components import connected_components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, component_id string, item string, size string, key string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, blank and long texts, exact and near copies, repeated rows, a null id, and names that clash."""
    base = words(120, 1)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, " ".join(base)), (8, " ".join(base)), (7, " ".join(base)), (None, "no id here at all"), (None, None)]
    for i in range(20):
        own = list(base)
        for j in range(i % 5):
            own[(i * 17 + j * 29) % 120] = f"edit{i}x{j}"
        rows.append((10 + i, " ".join(own)))
    rows += [(40 + i, "\n".join([" ".join(words(30, 100 + i, 5000)), "same line here", "same line here"])) for i in range(10)]
    rows.append((60, " ".join(words(30_000, 7, 100_000))))
    rows.append((61, "All rights reserved. cc by CC-BY. Released under the MIT License. " + " ".join(words(60, 9))))
    return spark.createDataFrame([(i, t, "en", ("a", "b", None)[(i or 0) % 3], 0, "k", "s", "c", "i", "z", "q") for i, t in rows], DOC)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, n=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute_components(rows):
    sets = collections.defaultdict(set)
    for i, t in rows:
        sets[i] |= shingles(t)
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return groups_of(sets, links)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    want = groups_of({x for a, b in links for x in (a, b)}, links)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    got = similarity_join.ngram_jaccard_join(docs.where("doc_id is not null")).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(shingles(t)), want[i]) for i, t in rows}
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1, 2, 3}


def test_jaccard_join_of_nothing(spark, docs):
    assert similarity_join.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_parity_maps_never_lose_a_link():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (5, 300, 700, 5000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], r.integers(0, 2**63, n // 3, dtype=np.uint64)]))
        x, y = similarity_join.parity_map(a), similarity_join.parity_map(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(similarity_join.folded(x, size) ^ similarity_join.folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_salted_posting_lists(spark, docs, monkeypatch):
    monkeypatch.setattr(similarity_join, "SALT_ROWS", 3)
    rows = docs.where("doc_id is not null and doc_id < 40")
    want = brute_components([(r.doc_id, r.text) for r in rows.collect()])
    assert {r.doc_id: r.component_id for r in similarity_join.ngram_jaccard_join(rows).collect()} == want


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (12, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs.unionByName(docs.limit(1).withColumn("text", F.lit("a b a b a b # a b"))), labels)
    assert set(docs.columns) <= set(got.columns) and got.columns.count("kept") == 1
    for r in got.collect():
        want = quality_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    none = quality_rules.quality_rules(docs, labels.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_quality_model_tells_junk_from_prose(spark):
    r = random.Random(2)
    prose = [(i, " ".join(f"word{r.randrange(300)}" for _ in range(90))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"word{r.randrange(300)}%%%" for _ in range(90))) for i in range(60)]
    df = spark.createDataFrame(prose + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality_rules.quality_rules(df, labels).where("kept").collect()}
    assert {i for i, _ in prose} <= kept and not kept & {i for i, _ in junk}


def test_mixing(spark, docs):
    got = source_mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    total = collections.Counter()
    for r in docs.collect():
        total[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(2 * total[s] for s in over)
        free = free - over if over else set()
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size and r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert sorted(got, key=repr) == sorted(source_mixing.mix_sources(docs.repartition(3)).collect(), key=repr)
    assert source_mixing.mix_sources(docs.limit(0)).count() == 0


def test_best_fit_matches_a_plain_version():
    r = random.Random(4)
    for _ in range(20):
        sizes = [(i, r.randrange(1, 60)) for i in range(80)]
        bins, place = [], {}
        for i, s in sorted(sizes, key=lambda x: (-x[1], x[0])):
            fit = [(c, b) for b, c in enumerate(bins) if c >= s]
            b = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append(100)
            bins[b] -= s
            place[i] = b
        assert bin_packing.best_fit_decreasing(sizes, 100) == place
    assert bin_packing.best_fit_decreasing([(1, 101)], 100) is None


def test_packing(spark, docs):
    got = bin_packing.pack(docs, shards=4).collect()
    slots, where = collections.defaultdict(list), collections.defaultdict(set)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert (r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
            where[t].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for t, v in where.items() if t is not None)
    assert bin_packing.pack(docs.limit(0)).count() == 0
    fixed = bin_packing.pack(docs, capacity=400_000)
    assert fixed.groupBy("shard").agg(F.sum("size").alias("s")).where("s > 400000").count() == 0
    with pytest.raises(ValueError):
        bin_packing.pack(docs, capacity=100)


def test_decontamination(spark, docs):
    item = "A train leaves the station at 30 miles per hour while Alice waits for 12 minutes before she buys 30 apples from the market"
    bench = spark.createDataFrame([(1, item, 0), (2, "short words here", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    plant = [
        (201, "x y z. " + item + " and so on"), (202, item.replace("30", "45").replace("miles", "km").replace("Alice", "Robert Smith").replace("12", "7")), (203, item.replace("30 apples", "31 apples")),
        (204, "Quite short words here it is"), (205, item[:40]),
        (206, "we saw " + item.replace("while Alice", "while alice").upper()), (207, item.replace(" ", "  ").replace("while", "While")),
    ]
    own = spark.createDataFrame(plant, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(own, bench, consistency=0.0).collect()}
    assert set(got) == {(201, 1), (202, 1), (203, 1), (204, 2), (206, 1), (207, 1)}
    assert got[201, 1].n_changed == 0 and got[202, 1].n_changed == 4 and got[202, 1].consistency == 1.0 and got[203, 1].consistency < 1
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, rule):
    got = collections.defaultdict(float)
    total = {}
    for r in token_counts.attribute_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rule).collect():
        got[r.doc_id] += r.n_tokens
        total[r.doc_id] = r.doc_tokens
    encoding, width = token_counts.load_encoding(token_counts.default_vocabulary())
    for r in docs.where("doc_id is not null").collect():
        assert total[r.doc_id] == len(encoding.encode_ordinary(r.text or "")) == pytest.approx(got[r.doc_id])
    text = "ab\n\ncdé\n  x"
    data = __import__("numpy").frombuffer(text.encode(), "uint8")
    edges, tokens = token_counts.section_edges(data), encoding.encode_ordinary(text)
    want, at = [0.0] * (len(edges) - 1), 0
    for t in tokens:
        n = len(encoding.decode_single_token_bytes(t))
        held = [max(0, min(edges[i + 1], at + n) - max(edges[i], at)) for i in range(len(edges) - 1)]
        if rule == "proportional":
            want = [w + h / n for w, h in zip(want, held, strict=True)]
        else:
            i = next(i for i, h in enumerate(held) if h) if rule == "start" else held.index(max(held))
            want[i] += 1
        at += n
    assert list(token_counts.allocate(width[tokens], edges, rule)) == pytest.approx(want)
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(docs, "none")


def test_feistel_is_a_permutation(spark):
    own = spark.range(5000).select("id", pseudonyms.feistel(F.col("id"), 50, 100, "k").alias("f"))
    assert own.select("f").distinct().count() == 5000 and own.where("f < 0 or f >= 5000").count() == 0
    assert own.where(pseudonyms.unfeistel(F.col("f"), 50, 100, "k") != F.col("id")).count() == 0
    digits = spark.createDataFrame([("0",), ("07",), ("123456789012345678901234567890",), ("",)], "d string")
    back = digits.select("d", pseudonyms.permute_digits(pseudonyms.permute_digits(F.col("d"), "k"), "k", back=True).alias("b"))
    assert back.where("d <> b").count() == 0


def test_pseudonyms(spark, docs):
    text = "mail Ann.Lee@example.com, card 4111 1111 1111 1111 and 4111111111111111, 2024-02-29, 31/12/1999, 10.1.2.3, +1 (743) 555-3824, f33e61083db5dbdf4bd2369d2f80176e57f7fda2, year 2024 v1"
    rows = spark.createDataFrame([(1, text), (2, "again 10.1.2.3 and 4111111111111111"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymize(rows, "k").collect()}
    new = got[1].text
    for secret in ("Ann", "4111 1111", "4111111111111111", "2024-02-29", "31/12/1999", "10.1.2.3", "555-3824", "f33e61083db5"):
        assert secret not in new
    assert "year 2024 v1" in new and got[1].n_found == got[1].n_replaced + 1
    card = re.search(r"and (\d{16}),", new)[1]
    assert card in got[2].text and re.search(r"card ([\d ]{19})", new)[1].replace(" ", "") == card
    odd = [int(c) for c in card[::-1]]
    assert (sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])) % 10 == 0
    assert (got[3].text, got[3].n_found, got[4].text) == (None, 0, "")
    clash = pseudonyms.pseudonymize(docs.withColumn("n_found", F.lit("x")), "k")
    assert clash.columns.count("n_found") == 1 and clash.count() == docs.count()
    assert pseudonyms.pseudonymize(rows, "other key").where("doc_id = 1").first().text != new


def test_url_filters(spark):
    link = '<a href="https://bad.net/x">x</a> <A HREF=//friend.org/y>y</A> <a href="/local">z</a>'
    rows = [(1, "http://bad.net/x", None), (2, "https://www.linker.io/", link), (3, "https://Good.org/FR/", ""), (4, "https://a.org/fr/1?q", None), (5, "https://example.net/en/1", None), (6, "https://sub.example.com/de/1", None), (7, "https://sub.example.com/en/1", None), (8, None, None), (9, "nothing", "<a href='https://bad.net'>"), (10, "https://x.net#/y", None), (11, "https://bad.net/2", link), (2, "https://www.linker.io/", link), (12, "https://friend.org/z", None), (13, "ftp://u@H.net:80/p/a?b#c", None)]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame([(*x, "q", "r") for x in rows], "page_id long, url string, html string, host string, rule string")).collect()]
    by = {x[0]: x[1:] for x in got}
    assert len(got) == len(rows)
    assert by[1] == ("bad.net", "/x", "net/", "block") and by[4] == ("a.org", "/fr/1", "org/fr/", "allow") and by[3][2] is None
    assert by[5][2:] == ("example.net/en/", "allow") and by[6][2:] == ("example.com/de/", "block") and by[7][2] is None
    assert by[8] == by[9] == ("", "", None, "allow") and by[10] == ("x.net", "", None, "allow") and by[13] == ("h.net:80".replace("h", "u@h"), "/p/a", None, "allow")
    assert by[2][3] == "block"  # it links to a blocked host
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_matches_dense_iteration(spark):
    r = random.Random(6)
    edges = list({(f"h{r.randrange(12)}", f"h{r.randrange(12)}") for _ in range(30)})
    seeds = {f"h{i}": (i % 4) / 3 for i in range(12)}
    kinds = lambda rows: [(k, *x) for x in rows for k in ("a", "b")]
    found = url_filters.propagate(spark.createDataFrame(kinds(seeds.items()), "kind string, host string, seed double"), spark.createDataFrame(kinds(edges), "kind string, src string, dst string"), rounds=6)
    got = {x.host: x.score for x in found.where("kind = 'a'").collect()}
    assert got == {x.host: x.score for x in found.where("kind = 'b'").collect()}
    degree, now = collections.Counter(a for a, _ in edges), {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(6):
        moved = collections.Counter()
        for a, b in edges:
            moved[b] += now[a] / degree[a]
        now = {h: 0.15 * s + 0.85 * moved[h] for h, s in seeds.items()}
    assert got == pytest.approx(now)


def test_languages(spark):
    own = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "123 !!", "de"), (None, "the and of", None)], "doc_id long, text string, lang string")
    got = language_mixture.identify_languages(own.unionByName(extra)).collect()
    lang = {r.doc_id: r.lang for r in own.collect()}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (9001, 9002, 9003)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_mixture.identify_languages(extra.limit(0)).count() == 0


def test_language_sets_of_mixed_texts():
    import numpy as np

    r = np.random.default_rng(1)
    words = r.normal(-30, 1, (400, 3))
    words[:250, 0] += 12
    words[250:, 1] += 12
    share = language_mixture.infer(words, np.array([0, 400, 400]))
    assert share[0] == pytest.approx([0.625, 0.375, 0], abs=0.02) and not share[1].any()


def test_license_scan(spark, docs):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == docs.count()
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in got:
        if r.doc_id is None:
            continue
        w = split.findall(lowered(text[r.doc_id]))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    r = next(r for r in got if r.doc_id == 61)
    assert (r.base_labels, r.labels, r.n_base, r.score) == ("cc-by,reserved", "cc-by,mit,reserved", 3, 1.0)
    gap = spark.createDataFrame([(1, "permission is hereby granted free of charge to any new person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction")], "doc_id long, text string")
    assert license_scan.license_scan(gap).first().labels == "mit"
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        docs = P.C.cut(stage(spark, docs, PATH))
        seen.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0 and seen[4] == seen[5] > seen[3]
    assert docs.select("shard").distinct().count() <= 16


def test_pipeline_stages_on_nothing(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.C.cut(stage(spark, docs, PATH))
        assert docs.count() == 0


def test_queries_have_their_columns(spark):
    from shotloom.llm.registry import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_jaccard_join_against_its_sql(spark):
    from tests.compare import compare, connect

    name = "op10_ngram_jaccard_join"
    from shotloom.llm import registry

    assert compare(spark, connect(PATH), PATH, name, registry.QUERIES[name], registry.ORACLES[name]) is None
