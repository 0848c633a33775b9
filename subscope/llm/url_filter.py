"""URL decisions by host and path rules, spread to aliases over redirect and canonical links.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import graph

# (verdict, host, path): a rule fits its host and all subdomains where the path starts alike
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for a null or scheme-less url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule; null where none fits. Of two equally long ones an allow wins."""
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow"))
    for kind, rule_host, rule_path in ordered:
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def address(url: Column) -> Column:
    """One spelling of an address: no scheme, fragment or trailing slash, host in lower case. Null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), query))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty where there is none."""
    pattern = r"""(?is)[\s"'/]""" + name + r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolved(base: Column, to: Column) -> Column:
    """A link's target as an address: absolute, or relative to scheme, host, folder or query of the page it stands on.

    Null for fragments of the page itself and for schemes without an authority, such as mailto.
    """
    authority = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(own, r"(?s)^(.*)/", 1), F.lit("/"))
    absolute = (
        F.when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*+://"), to)
        .when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*+:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(authority, to))
        .when(to.startswith("?"), F.concat(authority, own, to))
        .when(to.startswith("#"), F.lit(None))
        .otherwise(F.concat(authority, folder, to))
    )
    return _without_dots(absolute)


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` steps of the path taken."""
    own = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+/?+([^?#]*)", 1)
    steps = F.aggregate(
        F.split(own, "/"), F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done).otherwise(F.concat(done, F.array(step))),
    )
    rest = F.regexp_extract(url, r"(?s)^[^?#]*+(.*)", 1)
    short = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.lit("/"), F.array_join(steps, "/"), rest)
    return F.when(own.rlike(r"(?s)(^|/)\.\.?(/|$)"), short).otherwise(url)


def links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): every canonical link and refresh in the html, resolved against the page's address.

    A canonical link is a link tag with ``canonical`` among the words of its rel, a refresh a meta tag with the target in its
    content. The entity for & is decoded; base tags are not looked at. Pages without an address have no links.
    """
    html = F.col("html")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*+>"), F.lit(0))
    canonical = F.filter(tags("link"), lambda t: _attribute(t, "rel").rlike(r"(?is)(^|\s)canonical(\s|$)"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    target = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]++)""", 1)
    targets = F.concat(F.transform(canonical, lambda t: F.trim(_attribute(t, "href"))), F.transform(refresh, target))
    found = pages.where(html.rlike("(?i)canonical|http-equiv") & F.col("url").contains("://"))
    found = found.select("url", F.explode(targets).alias("to")).where(F.col("to") != "")
    to = F.regexp_replace("to", r"(?i)&(?:amp|#38|#x26);", "&")
    return found.select(F.col("url").alias("from_url"), resolved(F.col("url"), to).alias("to_url")).where(F.col("to_url").isNotNull())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by), one row per row of ``pages``.

    An address with a rule keeps that rule's verdict. One without gets a block if its
    component over redirects, canonical links and spellings of the same address holds a
    blocked address and no allowed one: an explicit allow takes precedence over a block
    reached through aliases. Everything else is allowed, null and scheme-less urls included.
    ``redirects``: more (from_url, to_url) rows, which may name urls that have no page.
    """
    page = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    edges = links(page)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    h, p = host(F.col("url")), path(F.col("url"))
    edges = materialize(edges.where(address(F.col("from_url")) != address(F.col("to_url"))).distinct(), "links")
    judged = page.select("page_id", "url", h.alias("host"), p.alias("path"), address(F.col("url")).alias("address"))
    rule, own = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "own": own})

    # votes of the addresses that pages or links name; spellings of one address vote together
    ends = edges.select(F.col("from_url").alias("url")).union(edges.select(F.col("to_url").alias("url")))
    r, o = rule_of(host(F.col("url")), path(F.col("url")), rules)
    named = ends.select(address(F.col("url")).alias("address"), o.alias("own")).union(judged.select("address", "own"))
    votes = named.where(F.col("address").isNotNull()).groupBy("address").agg(
        F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed")
    )
    # nodes are 128-bit digests, so that a component's least node is a short string
    node = lambda url: F.substring(F.sha2(address(F.col(url)), 256), 1, 32)
    parts = graph.components(edges.select(node("from_url").alias("u"), node("to_url").alias("v")))
    votes = votes.withColumn("node", F.substring(F.sha2("address", 256), 1, 32)).join(parts, "node", "left")
    votes = votes.withColumn("component", F.coalesce("component", "node"))
    group = votes.groupBy("component").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    group = group.where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).select("component", F.lit(True).alias("spread"))
    reached = votes.join(group, "component").select("address", "spread")
    out = judged.join(reached, "address", "left")
    verdict = F.coalesce("own", F.when(F.col("spread"), "block"), F.lit("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("spread"), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("decided_by"))
