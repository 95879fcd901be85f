"""Links to hosts that have no pages of their own."""

import pytest

from shotloom.llm import url_filters


def test_links_to_hosts_without_pages_count(spark):
    spam = "".join(f'<a href="http://S{i}.net/x">x</a>' for i in range(3))
    rows = [(1, "http://linker.io/", spam), (2, "http://clean.io/", '<a href="http://else.com/">x</a>'), (3, "http://c.io/", "<a href=//hub.org/y>y</a>"), (4, "http://a.hub.org", None)]
    rules = (("block", "net/"), ("allow", "hub.org/"), ("block", "else.com/part/"))
    got = {r.page_id: r for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].verdict == "block" and got[1].rule is None and got[1].distrust == pytest.approx(3 * 0.15 * 0.85)
    assert (got[2].verdict, got[2].distrust) == ("allow", 0)
    assert got[4].trust > 0.1  # from hub.org, which only rules and links name
