"""Link graph and propagation against brute force."""

import numpy as np
import pytest

from tests.conftest import SMALL
from tidepool.llm import url_filter

PAGES = "page_id long, url string, html string"


def page(host, *to):
    return f"http://{host}/x", "".join(f'<a href="{t}">' for t in to)


def walk(edges, seeds, damping):
    """Personalised PageRank by a linear system; dead ends go back to the seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m, start = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for (a, b), n in edges.items():
        m[at[b], at[a]] += n
    for h, v in seeds.items():
        start[at[h]] = v / sum(seeds.values())
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), start[:, None])
    got = np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * start)
    return {h: got[at[h]] for h in hosts}


GRAPHS = {
    "chain": [page("bad.org", "//c0.net/"), page("good.org", "http://c3.net/a")] + [page(f"c{k}.net", f"http://c{k + 1}.net/") for k in range(13)] + [page("c13.net", "http://bad.org/")],
    "hub": [page("hub.net", "http://bad.org/", "http://good.org/", *(f"https://s{k}.net" for k in range(8)))] + [page(f"s{k}.net", "http://HUB.net/?q") for k in range(8)] + [page("good.org", "http://hub.net"), page("bad.org"), page("bad.org", "//s1.net")],
    "dead ends": [page("good.org", "http://a.net", "http://b.net", "http://a.net"), page("a.net"), page("b.net", "http://bad.org"), page("bad.org")],
    "apart": [page("good.org", "http://a.net"), page("a.net", "http://good.org"), page("b.net", "http://bad.org"), page("bad.org", "http://b.net"), page("c.net", "http://d.net")],
    "no edges": [page("good.org", "/x", "y", "#z", "mailto:a@bad.org", "http://good.org/self"), page("bad.org"), page("c.net")],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_judged_pages_against_page_rank(spark, name):
    rows = GRAPHS[name]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], PAGES)
    rules = [url_filter.Rule("block", "bad.org", "/"), url_filter.Rule("allow", "good.org", "/")]
    edges = {(r.src, r.dst): r.n for r in url_filter.host_edges(pages.withColumn("host", url_filter.host_of(pages.url))).collect()}
    assert (not edges) == (name == "no edges") and all(a != b for a, b in edges)
    count = lambda h: sum(r[0] == f"http://{h}/x" for r in rows)
    damping = 0.85 if name == "chain" else 0.5  # fewer rounds
    trust, distrust = walk(edges, {"good.org": count("good.org")}, damping), walk({(b, a): n for (a, b), n in edges.items()}, {"bad.org": count("bad.org")}, damping)
    got = {r.host: r for r in url_filter.judge_urls(pages, rules, damping=damping).collect()}
    for h, r in got.items():
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        assert abs((r.trust or 0) - t) < 1e-5 and abs((r.distrust or 0) - d) < 1e-5
        if h not in ("bad.org", "good.org"):
            assert r.verdict == ("block" if d > t else "allow")


def test_links_of_every_form(spark):
    html = ["<A class=x HREF='//b.net/p'><link href=https://c.net>", '<base target="_top" href="http://d.net/q/"><a href="rel"><a href="//b.net">', '<a href="http://A.net/"><a title="href" >', None, "", '<a href="//">', "<a href"]
    pages = spark.createDataFrame([("a.net", x) for x in html], "host string, html string")
    assert {(r.src, r.dst, r.n) for r in url_filter.host_edges(pages).collect()} == {("a.net", "b.net", 2), ("a.net", "c.net", 1), ("a.net", "d.net", 1)}


def test_rules_and_edge_cases(spark):
    rules = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "x.com", "/en/7"), url_filter.Rule("allow", "x.com", "/en/7")]
    urls = {"http://a.com/en/": ("a.com", "/en/", "com/en/", "block"), "HTTP://A.b.Example.COM/en/7?x": ("a.b.example.com", "/en/7", "example.com/en/7", "allow"), "http://bexample.com/en/77#/": ("bexample.com", "/en/77", "com/en/", "block"), "s://x.com/en/7": ("x.com", "/en/7", "x.com/en/7", "block"), "a.com/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://com/": ("com", "/", None, "allow"), "s://y.net?u://z": ("y.net", "", None, "allow"), "s://l.net/" + "p" * 100_000: ("l.net", "/" + "p" * 100_000, None, "allow"), "://": ("", "", None, "allow")}
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(None, "http://a.com/en/", ""), (0, "http://a.com/en/", "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as r", "3 as trust")
    more = [url_filter.Rule("block", f"h{k}.org", "/") for k in range(url_filter.RULES_IN_PLAN)]
    for own in (rules, rules + more):
        got = url_filter.judge_urls(pages, own).collect()
        assert len(got) == len(rows)
        for r in got:
            url = "http://a.com/en/" if r.page_id is None else list(urls)[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict) == urls[url]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_ties_and_very_long_pages(spark):
    """Of equal trust and distrust a host is allowed; links of a very long page all count."""
    rows = [page("good.org", "http://m.net"), page("m.net", "http://bad.org"), page("bad.org"), ("http://long.net/", "x" * 2_000_000 + '<a href="//bad.org/">' * 50_000 + '<a href="//m.net/">')]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], PAGES)
    edges = {(r.src, r.dst): r.n for r in url_filter.host_edges(pages.withColumn("host", url_filter.host_of(pages.url))).collect()}
    assert edges["long.net", "bad.org"] == 50_000 and edges["long.net", "m.net"] == 1
    rules = [url_filter.Rule("block", "bad.org", "/"), url_filter.Rule("allow", "good.org", "/")]
    got = {r.host: r for r in url_filter.judge_urls(pages.where("page_id < 3"), rules, damping=0.5).collect()}
    assert got["m.net"].trust == got["m.net"].distrust > 0 and got["m.net"].verdict == "allow"
    assert {r.host: r.verdict for r in url_filter.judge_urls(pages, rules, damping=0.5).collect()}["long.net"] == "block"


def test_given_pages_link_to_no_other_host(spark):
    """All links of the given pages are relative, so that their verdicts follow from rules and seeds alone."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert url_filter.host_edges(pages.withColumn("host", url_filter.host_of(pages.url))).count() == 0
