"""URL filters with link-graph propagation (operator 5). DataFrame functions only.

Rules decide the urls they fit. For the others, a host's standing decides: the share of its pages
that rules allow seeds trust, the share they block seeds distrust. Trust flows along host edges
(personalised PageRank); distrust flows against them, from a blocked host to those that link to
it. A host whose distrust reaches a threshold and exceeds its trust is blocked.

Every host that a page links to is a node, also if it has no page itself; then the rule that fits
its root path seeds it. Only hosts with pages are in the result.

Host edges are the links of the pages' html to other hosts, and a host's tie to its nearest parent
domain among the hosts seen, both ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .license_scan import LOWERED, UPPER

#: (verdict, rule); a rule is a host followed by a path. Fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Propagation ends when a few rounds change no score by more; a thousandth of the threshold.
TOLERANCE = 7.5e-5
#: Rounds of one plan.
CUT_ROUNDS = 5
#: Least distrust of a blocked host; a host without edges reaches it when half of its pages are blocked.
THRESHOLD = 0.5 * (1 - DAMPING)
#: Rules are broadcast up to this number; beyond it the join shuffles.
BROADCAST_RULES = 100_000

LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url):
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + 3), "/", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWERED)).otherwise("")


def path_of(url):
    rest = F.substr(url, F.instr(url, "://") + 3)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when((F.instr(url, "://") > 0) & (at > 0), F.substr(rest, at)).otherwise("")


def labels_in(name):
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the longest rule that fits each distinct (host, path); places without one are left out.

    Of a host only its last labels are tried, as many as the longest rule's domain has.
    """
    split = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("domain"), F.substr(F.col("rule"), F.instr("rule", "/")).alias("start"))
    deepest = split.agg(F.max(labels_in(F.col("domain")))).first()[0] or 0
    wide = places.where("host <> ''").withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(1, deepest)), labels_in(F.col("host"))))))
    wide = wide.select("host", "path", F.expr("substring_index(host, '.', -i)").alias("domain"))
    fits = wide.join(split, "domain").where(F.startswith(F.col("path"), F.col("start")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule"), F.col("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the distinct links of pages (host, html) to other hosts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWERED)))).alias("dst"))
    return links.where("src <> dst").distinct()


def nearest_parents(hosts: DataFrame) -> DataFrame:
    """(host, parent) for every distinct host that ends in another one of the table at a label's edge; the longest such end.

    Linear in the hosts' lengths: labels are exploded from the last one on with the host's hash alone, and an end is known
    by the exclusive or of its labels' hashes, each taken with its place. Pairs found by their 128 bits are compared as text.
    """
    seeded = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit("second"), *c))
    named = hosts.select("host", *(h.alias(n) for n, h in zip(("h1", "h2"), seeded("host"), strict=True)))
    labels = named.select("h1", "h2", F.posexplode(F.reverse(F.split("host", "[.]"))).alias("j", "label"))
    upto = Window.partitionBy("h1", "h2").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    one, two = seeded("label", "j")
    ends = labels.withColumns({"e1": F.bit_xor(one).over(upto), "e2": F.bit_xor(two).over(upto), "n": F.count("*").over(Window.partitionBy("h1", "h2"))})
    whole = ends.where("j = n - 1").select("e1", "e2", F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    found = ends.where("j < n - 1").select("h1", "h2", "j", "e1", "e2").join(whole, ["e1", "e2"]).groupBy("h1", "h2").agg(F.max_by(F.struct("p1", "p2"), "j").alias("p")).select("h1", "h2", "p.*")
    parents = named.select(F.col("host").alias("parent"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    return found.join(named, ["h1", "h2"]).join(parents, ["p1", "p2"]).where(F.endswith("host", F.concat(F.lit("."), F.col("parent")))).select("host", "parent")


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst): the links and the ties of hosts to parent domains; no self edges, repeated links count once."""
    up = C.cut(nearest_parents(hosts))
    ties = up.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(up.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return links.unionByName(ties).where("src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank of every kind of standing, with restarts at seeds (kind, host, seed), which lists every host of a kind; edges (kind, src, dst).

    Scores are not scaled to sum 1, so they don't shrink as hosts are added. Rounds go on until no
    score moves by more than the tolerance, which comes at last as each round shrinks the moves by
    damping; a number of rounds replaces that test. Every few rounds are cut, in shared storage.
    """
    out = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    weighted = C.cut(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(1.0) / F.col("degree")).alias("w")))
    now = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    if weighted.isEmpty():
        return now
    done = 0
    while rounds is None or done < rounds:
        before = now
        for _ in range(min(CUT_ROUNDS, (rounds or done + CUT_ROUNDS) - done)):
            moved = weighted.join(now, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
            now = seeds.join(moved, ["kind", "host"], "left").select("kind", "host", (F.col("seed") * (1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
            done += 1
        now = C.cut(now)
        if rounds is None:
            most = now.join(before.withColumnRenamed("score", "was"), ["kind", "host"]).agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
            if not most or most <= tolerance:
                break
    return now


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html).

    A null url or one without :// has an empty host and path, no rule and verdict allow. The longest
    fitting rule wins, equal lengths by text. Links to hosts without pages count; for such a host the
    longest rule that fits its path / gives the seed, so rules for parts of it don't. Hosts without edges keep their own seeds. Null html has
    no links. Repeated rows stay; they seed as often as they occur. Work is
    linear in the length of a url, a link and a host, whatever its labels. Extra columns are ignored. Empty tables give an empty result.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = C.cut(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")))
    table = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    ruled = fitting_rules(rows.select("host", "path").distinct(), table)
    rows = C.cut(rows.join(ruled, ["host", "path"], "left"))
    share = lambda v: (F.count_if(F.col("verdict") == v) / F.count("*"))
    hosts = C.cut(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    links = C.cut(host_links(pages.select(host_of(url).alias("host"), "html")))
    beyond = links.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").withColumn("path", F.lit("/"))
    seeded = lambda v: F.coalesce((F.col("verdict") == v).cast("double"), F.lit(0.0)).alias("trust" if v == "allow" else "distrust")
    beyond = beyond.join(fitting_rules(beyond, table), ["host", "path"], "left").select("host", seeded("allow"), seeded("block"))
    hosts = C.cut(hosts.unionByName(beyond))
    edges = C.cut(host_edges(links, hosts.select("host")))
    kinds = ("trust", "distrust")
    seeds = C.cut(hosts.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in kinds))).alias("x")).select("x.kind", "host", "x.seed"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    scores = propagate(seeds, both, damping)
    standing = scores.groupBy("host").agg(*(F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in kinds))
    found = rows.join(standing, "host", "left")
    near = lambda c: F.round(c, 3)  # noqa: E731  (sums in another order, or a round more, don't decide)
    bad = (near("distrust") >= round(threshold, 3)) & (near("distrust") > near("trust"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filters(spark, sf_dir):
    return filter_urls(C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: 80 rounds leave at most 0.85 ** 80 of the mass, well under the tolerance.
ORACLE = rf"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWERED}') AS host, regexp_extract(rest, '^[^?#]*') AS whole FROM u),
p AS (SELECT page_id, html, host, CASE WHEN instr(whole, '/') > 0 THEN substr(whole, instr(whole, '/')) ELSE '' END AS path FROM q),
rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
links AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, unnest(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda h: translate(h, '{UPPER}', '{LOWERED}'))) AS dst FROM p WHERE host <> '') WHERE src <> dst),
places AS (SELECT DISTINCT host, path FROM p WHERE host <> '' UNION SELECT dst, '/' FROM links),
wide AS (SELECT host, path, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain FROM places),
fits AS (SELECT host, path, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) AS best FROM wide JOIN rules ON domain = regexp_extract(rule, '^[^/]*') AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY host, path),
ruled AS (SELECT p.page_id, p.host, p.path, best.rule AS rule, best.verdict AS verdict FROM p LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path),
own AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*)::DOUBLE AS trust, count(*) FILTER (verdict = 'block') / count(*)::DOUBLE AS distrust FROM ruled WHERE host <> '' GROUP BY host),
hosts AS (SELECT * FROM own UNION ALL SELECT dst, CASE WHEN best.verdict = 'allow' THEN 1 ELSE 0 END, CASE WHEN best.verdict = 'block' THEN 1 ELSE 0 END
  FROM (SELECT DISTINCT dst FROM links WHERE dst NOT IN (SELECT host FROM own)) LEFT JOIN fits ON fits.host = dst AND fits.path = '/'),
up AS (SELECT host, unnest(range(2, len(string_split(host, '.')) + 1)) AS i FROM hosts),
ties AS (SELECT up.host, arg_min(h.host, i) AS parent FROM up JOIN hosts h ON h.host = array_to_string(string_split(up.host, '.')[i:], '.') GROUP BY up.host),
edges AS (SELECT src, dst FROM links UNION SELECT host, parent FROM ties UNION SELECT parent, host FROM ties),
ways AS (SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
w AS (SELECT kind, src, dst, 1::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS w FROM ways),
seeds AS (SELECT 'trust' AS kind, host, trust AS seed FROM hosts UNION ALL SELECT 'distrust', host, distrust FROM hosts),
ranks(k, kind, host, score) AS (SELECT 0, kind, host, seed * 0.15::DOUBLE FROM seeds UNION ALL
  SELECT any_value(r.k) + 1, s.kind, s.host, any_value(s.seed) * 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(m.score * w.w), 0) FROM seeds s JOIN ranks r ON r.kind = s.kind AND r.host = s.host
  LEFT JOIN w ON w.kind = s.kind AND w.dst = s.host LEFT JOIN ranks m ON m.kind = w.kind AND m.host = w.src WHERE r.k < 80 GROUP BY s.kind, s.host),
final AS (SELECT host, round(max(score) FILTER (kind = 'trust'), 3) AS trust, round(max(score) FILTER (kind = 'distrust'), 3) AS distrust FROM ranks WHERE k = 80 GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE WHEN distrust >= {round(THRESHOLD, 3)} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN final ON ruled.host = final.host"""
