"""Links of real pages: entities, dot segments, queries, base, odd hosts; nodes in their normal form."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from colforge.llm import url_filter
from colforge.llm.common import materialize

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SCHEMA = "page_id long, url string, html string"


def canonical(link):
    return f'<p title="a>b"><link rel="canonical" href="{link}">'


def test_links_as_a_browser_reads_them(spark):
    pages = [
        (1, "https://example.com/x/y/page", canonical("../../de/x")),  # to a blocked path
        (2, "https://one.org/", canonical("https://bad.net")),
        (3, "https://one.org", None),  # the same resource as 2
        (4, "https://two.org/start", canonical("/go?u=http://bad.net/p")),  # a link within two.org
        (5, "https://three.org/list?a=1&b=2", None),
        (6, "https://three.org/other", canonical("?a=1&amp;b=2")),  # /other?a=1&b=2
        (7, "https://three.org/other?a=1&b=2", canonical("http:&#47;&#x2F;bad.net/q")),
        (8, "https://four.org/a/b/c", '<base href="https://bad.net/deep/"><link rel="alternate canonical" href="./x">'),
        (9, "https://five.org/a", canonical("http://[bad.net/x")),
        (10, "https://six.org/a/./b/../c", canonical("https://bad.net/s")),
        (11, "https://six.org/a/c#top", None),
        (12, "https://seven.org/a", "<meta content='5;url=&quot;//bad.net/r&quot;' http-equiv=Refresh>"),
        (13, "https://eight.org/a", "<link rel=stylesheet href=https://bad.net/canonical>"),
        (14, "https://nine.org/a", "x" * 2_000_000 + canonical("https://bad.net/long") + "<link " * 10_000),
        (15, "https://ten.org/a", '<link rel="canonical"><meta http-equiv="refresh" content="3">'),
    ]
    out = {r.page_id: (r.verdict, r.by_alias) for r in url_filter.judge(spark.createDataFrame(pages, SCHEMA).repartition(4), RULES).collect()}
    blocked = {1, 2, 3, 6, 7, 8, 10, 11, 12, 14}
    assert out == {k: ("block", True) if k in blocked else ("allow", False) for k, _, _ in pages}


def test_paths_without_dots_equal_the_library(spark):
    rng = random.Random(3)
    paths = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "", "c.d", "..."]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    df = materialize(spark.createDataFrame([(p,) for p in paths], "p string"))
    for r in df.select("p", url_filter.node_of(F.concat(F.lit("HTTP://H.x"), "p", F.lit("?q=/../#f"))).alias("n")).collect():
        # Against a base on another path, so that the library resolves the segments of the link.
        want = urljoin("http://h.x/base/", r.p) if not r.p.startswith("//") else None
        if want and "//" not in r.p[1:]:
            assert r.n == want + "?q=/../", r.p
        assert not any(x in r.n.removesuffix("?q=/../").split("/")[3:] for x in (".", ".."))


def test_the_components_of_links_equal_brute_force(spark):
    rng = random.Random(8)
    hosts = ["https://a.org", "https://b.org", "https://bad.net", "https://example.net/en"]
    urls = [f"{rng.choice(hosts)}/{k}" for k in range(120)]
    links = [(u, rng.choice(urls)) if rng.random() < 0.6 else (u, None) for u in urls]
    df = spark.createDataFrame([(k, u, canonical(v) if v else None) for k, (u, v) in enumerate(links)], SCHEMA).repartition(3)
    group = {u: u for u in urls}
    for _ in urls:
        for u, v in links:
            if v:
                group[u] = group[v] = min(group[u], group[v])
    own = {u: "block" if u.startswith("https://bad") else "allow" if "/en/" in u else None for u in urls}
    bad = {group[u] for u in urls if own[u] == "block"}
    got = {r.page_id: r.verdict for r in url_filter.judge(df, RULES).collect()}
    assert got == {k: own[u] or ("block" if group[u] in bad else "allow") for k, u in enumerate(urls)}
