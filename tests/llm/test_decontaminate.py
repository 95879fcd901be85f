"""Template decontamination against a plain version, on families of items, scattered pieces and odd ids."""

import collections
import random
import re

from shotloom.llm import decontaminate as D

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W_]+", re.UNICODE)


def tokens(text):
    """(canonical token, value or None) of a text of lower-case words: names don't occur."""
    out = []
    for t in TOKEN.findall(text.lower()):
        number, unit = t[0].isdigit() or t in D.NUMBERS, t in D.UNITS
        out.append(("#" if number else "~" if unit else t, t if number or unit else None))
    return out


def brute(docs, items, gap=D.GAP):
    """{(doc, item): coverage, consistency} by comparing every window of every text with every item's."""
    best = {}
    for doc, text in docs:
        for item, own in items:
            a, b = tokens(own), tokens(text)
            k = min(D.WINDOW, len(a))
            hits = collections.defaultdict(list)
            for views in (False, True):
                hits.clear()
                sizes = [0]
                for i in range(len(a) - k + 1 if k else 0):
                    exact = sum(v is None for _, v in a[i : i + k]) < min(D.LITERALS, k)
                    if exact and not views:
                        continue
                    sizes.append(i + k)
                    for j in range(len(b) - k + 1):
                        same = a[i : i + k] == b[j : j + k] if exact else [t for t, _ in a[i : i + k]] == [t for t, _ in b[j : j + k]]
                        if same:
                            hits[j - i].append((i, j))
                chain, last, first = [], None, None
                chains = []
                for d in sorted(hits):
                    if last is None or d - last > gap:
                        chain, first = [], d
                        chains.append({})
                    last = d
                    chains[-1].setdefault((d - first) // max(sizes), []).extend(hits[d])
                for part in (p for c in chains for p in c.values()):
                    covered = {i + x for i, _ in part for x in range(k)}
                    pairs = collections.defaultdict(set)
                    for i, j in part:
                        for x in range(k):
                            if a[i + x][1] is not None:
                                pairs[a[i + x][1]].add(b[j + x][1])
                    score = (len(covered) / max(sizes), sum(len(v) == 1 for v in pairs.values()) / len(pairs) if pairs else 1.0)
                    if score[0] >= D.COVERAGE and score[1] >= D.CONSISTENCY:
                        best[doc, item] = max(score, best.get((doc, item), (0, 0)))
    return best


def test_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = ["apple", "train", "runs", "with", "many", "small", "green", "boxes", "and", "then", "km", "hours", "five"]
    make = lambda n: " ".join(r.choice([*vocabulary, str(r.randrange(30))]) for _ in range(n))
    items = [(i, make(r.choice((3, 6, 8, 9, 14, 25, 40)))) for i in range(25)]
    docs = []
    for i in range(120):
        text = r.choice(items)[1]
        own = text.split()
        kind = i % 6
        if kind == 1:  # other numbers, each by one counterpart
            own = [str(int(w) + 50) if w.isdigit() else w for w in own]
        elif kind == 2:
            own[r.randrange(len(own))] = r.choice(vocabulary)
        elif kind == 3:
            own.insert(r.randrange(len(own)), "extra words put in")
        elif kind == 4:
            own = own[: len(own) // 2]
        elif kind == 5:
            own = [str(r.randrange(90)) if w.isdigit() else w for w in own]
        docs.append((i, f"{make(12)}. {' '.join(own)}. {make(5)}"))
    got = {(x.doc_id, x.item_id): (x.coverage, x.consistency) for x in D.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    cls = {x.item_id: x.class_id for x in D.item_classes(spark.createDataFrame(items, ITEM)).collect()}
    want = {k: v for k, v in brute(docs, items).items() if cls[k[1]] == k[1]}
    assert got == want and len(want) > 60


def test_pieces_in_another_order_are_no_copy(spark):
    own = [f"word{k}" for k in range(80)]
    pieces = [own[k : k + 10] for k in range(0, 80, 10)]
    random.Random(2).shuffle(pieces)
    pad = " ".join(f"pad{k}" for k in range(30))
    rows = [(1, f" {pad} ".join(" ".join(p) for p in pieces)), (2, pad + " " + " ".join(own)), (3, " ".join([*own[:40], "some", "more", "words", *own[40:]]))]
    got = {x.doc_id: x.coverage for x in D.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, " ".join(own))], ITEM)).collect()}
    assert set(got) == {2, 3} and got[2] == 1 and got[3] > 0.9


def test_items_of_one_template_are_one_class(spark):
    say = "A shop sells {} red and {} green boxes of tea to the man who waits outside".format
    items = [(i, say(i, i + 500)) for i in range(1, 60)] + [(100, say(7, 7))]
    rows = [(d, say(1000 + d, 5)) for d in range(20)] + [(50, say(9, 9)), (51, say(3, 503))]
    cls = {x.item_id: x.class_id for x in D.item_classes(spark.createDataFrame(items, ITEM)).collect()}
    assert cls == {i: 1 for i in range(1, 60)} | {100: 100}
    got = D.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(d, 1) for d in (*range(20), 50, 51)} | {(50, 100)}


def test_short_and_number_dense_items(spark):
    items = [(1, "What is 3 + 5?"), (2, "Solve 12 x 7 = 84"), (3, "Compute 17 * 23 + 9 - 4 / 2"), (4, "7")]
    rows = [(i, f"Here it is: {t} And more.") for i, t in items[:3]] + [(9, "What is 4 + 5? nothing")]
    got = {(x.doc_id, x.item_id) for x in D.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= got and not any(d == 9 for d, _ in got) and {d for d, i in got if i == 4} == {2}


def test_texts_under_one_id_and_without_one(spark):
    own = " ".join(f"word{k}" for k in range(40))
    half, rest = " ".join(own.split()[:18]), " ".join(own.split()[18:36])
    rows = [(1, half), (1, "p q " + rest), (None, own), (None, None), (2, own), (2, own), (2, "other")]
    items = [(1, own), (1, "quite another text of the same id stands here now"), (None, half)]
    got = [(x.doc_id, x.item_id, x.coverage) for x in D.contaminated(spark.createDataFrame(rows, DOC).selectExpr("*", "1 as item_id", "2 as reading"), spark.createDataFrame(items, ITEM).selectExpr("*", "1 as doc_id")).collect()]
    assert sorted(got, key=repr) == [(2, 1, 1.0), (None, 1, 1.0)]


def test_a_family_of_number_dense_items_is_one_class(spark):
    """Items of one template whose windows of few plain words differ: a row for each document, not for each pair."""
    head = "a train leaves the station in the morning and carries coal to the harbour where workers unload it with"
    item = lambda i: f"{head} {i + 1} {i + 2000} {i + 31} {i + 4700} {i + 550} {i + 66} {i + 77} {i + 80} cranes"
    bench = spark.createDataFrame([(i, item(i)) for i in range(100)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"Notes {k}: {item(k)} and so on.") for k in range(50)], "doc_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and {r.item_id for r in got} == {0}
    assert all(r.coverage == 1.0 and r.consistency == 1.0 for r in got)
    names = D.item_classes(bench).collect()
    assert {r.class_id for r in names} == {0} and {r.variant_id for r in names} == set(range(100))
    # the variant's own windows tell that nothing was changed
    assert {r.n_changed for r in got} == {0}
