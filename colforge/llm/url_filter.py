"""URL filter with redirect equivalence.

Rules name a host (it and all its subdomains) and the beginning of a path; the longest fitting rule judges a url. Pages
that are the same resource share a block: canonical links and redirects (`link rel=canonical`, `meta http-equiv=refresh`
in the html) are edges between urls, and every connected component of these edges that holds a url blocked by a rule
blocks all its aliases. An explicit rule takes precedence: a url whose own rule allows it stays allowed. Without a rule
and without a blocked alias a page is allowed.

The components are found by distributed contraction; nothing of them is collected. Urls without edges take no part, and
equal urls (A-Z of scheme and host lower-cased, an empty path as `/`, dot segments resolved, fragment cut off) are one
node. Links are made absolute as in a browser: entities decoded, against `<base href>` or the page, with dot segments and
query-only links; a link with an impossible host is none. Rules judge urls as they stand, nodes by their normal form. Null
urls, or urls without `://`, have an empty host and path, fit no rule and have no edges; null html has no links. Repeated
rows get equal verdicts. Very long html is read whole, page by page, and only where it has such a tag.
"""

from __future__ import annotations

import re
from functools import reduce
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, components, lower_ascii, materialize

TAG = re.compile(r"""<(?:link|meta|base)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""", re.I)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
REFRESH = re.compile(r"url\s*=\s*(.*)$", re.I | re.S)

Rule = tuple[str, str, str]  # host, beginning of the path, "block" or "allow"


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def node_of(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, `/` for an empty path, dot segments resolved, no fragment; null without `://`."""
    head = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = F.when(path == "", "/").when(path.rlike(r"/\.\.?(?:/|$)"), _without_dots(path)).otherwise(path)
    return F.when(url.contains("://"), F.concat(head, path, query))


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments of a path that begins with `/`, resolved; those above the root are cut off."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(held: Column, part: Column) -> Column:
        up = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", held).otherwise(F.concat(held, F.array(part)))

    held = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    return F.concat(F.array_join(held, "/"), F.when((last == ".") | (last == "..") | (F.size(held) == 1), "/").otherwise(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; fields are null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    answer = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return reduce(lambda rest, k: F.when(fits[k], answer[k]).otherwise(rest), range(len(ordered) - 1, -1, -1), nothing)


def _links(page: str, html: str) -> list[str]:
    """Targets of the canonical links and redirects of a page, made absolute; malformed ones are none."""
    found, base = [], page
    for tag in TAG.findall(html):
        named = {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v).strip() for k, v in ATTRIBUTE.findall(tag)}
        kind = tag[1:5].lower()
        if kind == "base" and base is page and named.get("href"):
            base = _resolved(page, named["href"]) or page
        elif kind == "link" and "canonical" in named.get("rel", "").lower().split():
            found.append(named.get("href", ""))
        elif kind == "meta" and named.get("http-equiv", "").lower() == "refresh":
            target = REFRESH.search(named.get("content", ""))
            found.append(target.group(1).strip().strip("\"'") if target else "")
    resolved = (_resolved(base, link) for link in found if link)
    return [link for link in resolved if link]


def _resolved(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:  # brackets in the host that are no address
        return None


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): urls of one resource, from canonical links and redirects in the html."""

    def run(batch: pa.RecordBatch):
        rows = [(u, link) for u, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for link in _links(u, html)]
        columns = list(zip(*rows)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["url", "link"])

    rows = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)"))
    rows = rows.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = materialize(rows.mapInArrow(by_batch(run), "url string, link string"))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("link")).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, and by_alias: whether the verdict comes from an alias."""
    node = F.col("node")
    groups = components(alias_edges(pages))
    ruled = groups.withColumn("own", rule_of(host_of(node), path_of(node), rules)["verdict"])
    blocked = ruled.groupBy("component").agg(F.max((F.col("own") == "block").cast("int")).alias("blocked")).where("blocked = 1")
    aliases = materialize(groups.join(blocked.select("component"), "component", "left_semi").select("node").distinct().withColumn("by_alias", F.lit(True)))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).join(aliases, "node", "left")
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("own.verdict", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    by_alias = F.col("own.verdict").isNull() & F.coalesce("by_alias", F.lit(False))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("by_alias"))
