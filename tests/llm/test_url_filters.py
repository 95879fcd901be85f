"""URL filters against a dense, plain propagation, and against the SQL."""

import collections
import random

import pytest

from shotloom.llm import registry, url_filters as U
from tests.compare import compare, connect


def test_against_its_sql(spark):
    path, name = "/root/testdata/sf0.001", "op5_url_filters"
    assert compare(spark, connect(path), path, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_propagation_goes_on_to_the_tolerance(spark):
    """A long chain needs many rounds."""
    hosts = [f"h{k:02}" for k in range(40)]
    seeds = spark.createDataFrame([("a", h, float(h == "h00")) for h in hosts], "kind string, host string, seed double")
    edges = spark.createDataFrame([("a", a, b) for a, b in zip(hosts, [*hosts[1:], "h00"], strict=True)], "kind string, src string, dst string")
    got = {x.host: x.score for x in U.propagate(seeds, edges, tolerance=1e-9).collect()}
    for k, h in enumerate(hosts):
        assert got[h] == pytest.approx(0.15 * 0.85**k / (1 - 0.85**40), abs=1e-7)


def test_the_whole_filter_against_a_plain_version(spark):
    r = random.Random(3)
    domains = ["a.com", "b.a.com", "c.b.a.com", "shop.org", "x.shop.org", "bad.net", "spam.net", "example.net", "news.io", "blog.news.io", "far.net", "hub.org"]
    rows = []
    for i in range(120):
        host = r.choice(domains[:10])
        links = "".join(f'<a href="https://{r.choice(domains).upper()}/p{k}">x</a>' for k in range(r.randrange(3)))
        rows.append((i, f"http://{host}/{r.choice(['en/', 'fr/', 'de/', ''])}{i}", links if i % 9 else None))
    rows += [(202, "http://quiet.io/x", None), (200, None, None), (201, "no scheme", "<a href='//bad.net'>")]
    got = {x.page_id: x for x in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def rule_of(host, path):
        fit = [(len(x), x, v) for v, x in U.RULES for d, _, p in [x.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        return max(fit)[1:] if fit else (None, None)

    place = {i: (u.split("://")[1].split("/")[0], "/" + u.split("/", 3)[3]) for i, u, _ in rows if u and "://" in u}
    counts = collections.defaultdict(list)
    for host, path in place.values():
        counts[host].append(rule_of(host, path)[1])
    links = {(place[i][0], x.split("/")[0].lower()) for i, _, h in rows if i in place and h for x in h.split("https://")[1:]}
    links = {(a, b) for a, b in links if a != b}
    seed = {h: {v: c.count(v) / len(c) for v in ("allow", "block")} for h, c in counts.items()}
    for _, b in links:
        seed.setdefault(b, {v: float(rule_of(b, "/")[1] == v) for v in ("allow", "block")})
    edges = set(links)
    for h in seed:
        up = [".".join(h.split(".")[k:]) for k in range(1, h.count(".") + 1)]
        if parent := next((u for u in up if u in seed), None):
            edges |= {(h, parent), (parent, h)}

    def rank(kind, pairs):
        degree, now = collections.Counter(a for a, _ in pairs), {h: 0.15 * s[kind] for h, s in seed.items()}
        for _ in range(200):
            moved = collections.Counter()
            for a, b in pairs:
                moved[b] += now[a] / degree[a]
            now = {h: 0.15 * s[kind] + 0.85 * moved[h] for h, s in seed.items()}
        return now

    trust, distrust = rank("allow", edges), rank("block", {(b, a) for a, b in edges})
    for i, (host, path) in place.items():
        rule, verdict = rule_of(host, path)
        assert got[i].trust == pytest.approx(trust[host], abs=1e-3) and got[i].distrust == pytest.approx(distrust[host], abs=1e-3)
        bad = round(distrust[host], 3) >= 0.075 and round(distrust[host], 3) > round(trust[host], 3)
        assert (got[i].rule, got[i].verdict) == (rule, verdict or ("block" if bad else "allow"))
    assert got[200].verdict == got[201].verdict == "allow" and got[201].host == ""
    assert {got[i].verdict for i in place if got[i].rule is None} == {"allow", "block"}


def test_nearest_parents_equal_a_plain_version(spark):
    r = random.Random(8)
    names = sorted({".".join(r.choice(("a", "b", "", "ab")) for _ in range(r.randrange(1, 6))) for _ in range(300)} - {""})
    got = {(x.host, x.parent) for x in U.nearest_parents(spark.createDataFrame([(n,) for n in names], "host string")).collect()}
    want = set()
    for n in names:
        parts = n.split(".")
        ups = [".".join(parts[i:]) for i in range(1, len(parts)) if ".".join(parts[i:]) in names]
        want |= {(n, ups[0])} if ups else set()
    assert got == want


def test_hosts_of_very_many_labels(spark):
    import time

    deep = ".".join("a" for _ in range(100_000))
    rows = [(1, f"http://{deep}.example.net/x", f'<a href="http://{deep}/">'), (2, "http://example.net/en/", f'<a href="http://b.{deep}.net/">'), (3, "http://w.example.com/de/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    U.filter_urls(pages.where("page_id = 3")).collect()  # the compiler's start isn't counted
    began = time.time()
    got = {x.page_id: (x.rule, x.verdict, len(x.host)) for x in U.filter_urls(pages).collect()}
    assert got == {1: ("net/", "block", 2 * 100_000 + 11), 2: ("example.net/en/", "allow", 11), 3: ("example.com/de/", "block", 13)}
    assert time.time() - began < 60
    began = time.time()
    hosts = spark.createDataFrame([(deep,), (f"b.{deep}",), ("a",)], "host string")
    assert {len(x.parent) for x in U.nearest_parents(hosts).collect()} == {1, len(deep)}
    assert time.time() - began < 10
