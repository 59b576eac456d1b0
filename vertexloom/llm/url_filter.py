"""URL allow and block rules that follow redirects and canonical links.

A rule names a host and the beginning of a path; it fits the host, its subdomains
and every path that starts so, and the longest fitting rule decides (of equally long
ones an allowing one).  Urls that a redirect or a canonical link connects are aliases:
their connected component is one resource.  A url without a rule of its own is
blocked if a rule blocks any of its aliases, pages of the table or not.  An explicit
allow goes before that: a url with its own rule keeps that rule's verdict.

Links are ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the html,
resolved against the page's url, and the link from a url with ``utm_`` parameters to
the one without.  Fragments are no part of a url's identity.

All work is native expressions, joins and aggregations.  A null url, or one without
``://``, has an empty host and path, no rule and no aliases, and so is allowed.  Null
html has no links, repeated rows are judged one by one, an empty table gives no rows,
and no other column of the pages is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import fair_share
from vertexloom.operators.components import connected_components
from vertexloom.operators.index import index_graph
from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import find_hot, lookup_join

#: Rules tables up to this size are broadcast (some 100 bytes a rule), larger ones shuffled.
LISTED_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns that Java and RE2 read alike; the SQL of the query uses the same ones.
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'>\s]+)"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?\s*([^\"'>\s]+)"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
TRACKING = r"[?&]utm_[^&]*"

Rules = Sequence[tuple[str, str, bool]]


def url_part(url: Column, part: int) -> Column:
    """1 scheme, 2 host as written, 3 path, 4 query with its ``?``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, part), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(url_part(url, 2), UPPER, LOWER)


def identity(url: Column) -> Column:
    """The url without fragment, its scheme and host in lower case; NULL without ``://``."""
    scheme = F.translate(url_part(url, 1), UPPER, LOWER)
    whole = F.concat(scheme, F.lit("://"), host_of(url), url_part(url, 3), url_part(url, 4))
    return F.when(F.contains(url, F.lit("://")), whole)


def without_tracking(url: Column) -> Column:
    """Identity of the url without its ``utm_`` parameters."""
    rest = F.regexp_replace(url_part(url, 4), TRACKING, "")
    query = F.when(F.startswith(rest, F.lit("&")), F.concat(F.lit("?"), F.substring(rest, 2, 1 << 30))).otherwise(rest)
    scheme = F.translate(url_part(url, 1), UPPER, LOWER)
    return F.concat(scheme, F.lit("://"), host_of(url), url_part(url, 3), query)


def resolve(href: Column, url: Column) -> Column:
    """Absolute url of a link on the page ``url``; NULL where it leads nowhere else."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    scheme, site = url_part(url, 1), F.concat(url_part(url, 1), F.lit("://"), url_part(url, 2))
    folder = F.regexp_replace(url_part(url, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((href == "") | F.startswith(href, F.lit("#")), F.lit(None))
        .when(href.rlike(ABSOLUTE), href)
        .when(href.rlike(OTHER_SCHEME), F.lit(None))
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .otherwise(F.concat(site, folder, href))
    )


def declared_links(html: Column) -> Column:
    """Targets, as written, of the canonical links and redirects of a page."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAGS), 0)
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), lambda t: F.regexp_extract(t, HREF, 1))
    redirect = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(t, TARGET, 1))
    return F.concat(canonical, redirect)


def _match(urls: DataFrame, rules: DataFrame, n_rules: int, n_urls: int) -> DataFrame:
    """``(key, rule, allow)`` for the urls ``(key, host, path)``, unique by key, that a rule fits.

    Equi-joins only: a url meets the rules of its host and of the domains above it,
    under the beginnings of its path that are as long as one of their paths.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    named = rules.groupBy(F.struct("host", "path").alias("named")).agg(F.max("allow").alias("allow"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    asked = urls.select("key", "path", F.explode(above).alias("domain"))
    small = n_rules <= LISTED_RULES

    def meet(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
        hot = None if small else find_hot(rows, key, n_urls, fair_share(rows, n_urls))
        return lookup_join(rows, key, F.broadcast(table) if small else table, table_key, hot, "key")

    found = meet(asked, "domain", lengths.withColumnRenamed("host", "rule_host"), "rule_host")
    found = found.select("key", "domain", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    begun = F.struct(F.col("domain").alias("host"), F.expr("substring(path, 1, n)").alias("path"))
    found = meet(found.select("key", begun.alias("begun")), "begun", named, "named")
    name = F.concat("begun.host", "begun.path")
    best = F.max(F.struct(F.length(name).alias("n"), F.col("allow"), name.alias("rule")))
    return found.groupBy("key").agg(best.alias("best")).select("key", "best.rule", "best.allow")


def judge_urls(pages: DataFrame, rules: Rules | DataFrame, scratch: Scratch) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, reason)`` of every row of ``pages``.

    ``rules`` are ``(host, path, allow)``; ``reason`` is rule, alias or default.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, allow boolean")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "allow").where("host IS NOT NULL AND path IS NOT NULL")
    n_rules = rules.count()
    url = F.col("url").cast("string")
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    # Numbered in a saved table: a stage that is run again could number rows differently.
    own = pages.select(
        F.monotonically_increasing_id().alias("key"), "page_id", url.alias("url"), declared_links(html).alias("hrefs")
    )
    own = own.select(
        "key", "page_id", "url", host_of(F.col("url")).alias("host"), url_part(F.col("url"), 3).alias("path"),
        identity(F.col("url")).alias("node"), F.transform("hrefs", lambda h: identity(resolve(h, F.col("url")))).alias("links"),
    )
    own = scratch.save(own, "urls")
    n_rows = own.count()

    linked = own.select(F.col("node").alias("src"), F.explode("links").alias("dst"))
    tracked = own.where(F.contains("node", F.lit("utm_"))).select(F.col("node").alias("src"), without_tracking(F.col("node")).alias("dst"))
    edges = scratch.save(linked.unionByName(tracked).where("src <> dst").distinct(), "alias-edges")
    blocked = _blocked_aliases(edges, rules, n_rules, scratch)

    ruled = own.join(_match(own, rules, n_rules, n_rows), "key", "left")
    free = ruled.where("rule IS NULL AND node IS NOT NULL").select("key", "node")
    hot = find_hot(own, "node", n_rows, fair_share(own, n_rows))
    by_alias = lookup_join(free, "node", blocked, "blocked", hot, "key", "left_semi").select(F.col("key").alias("alias_key"))
    joined = ruled.join(by_alias, F.col("key") == F.col("alias_key"), "left")
    allow = F.coalesce("allow", F.col("alias_key").isNull())
    reason = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_key").isNotNull(), "alias").otherwise("default")
    verdict = F.when(allow, "allow").otherwise("block")
    return joined.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), reason.alias("reason"))


def _blocked_aliases(edges: DataFrame, rules: DataFrame, n_rules: int, scratch: Scratch) -> DataFrame:
    """Urls ``(blocked)`` of components that hold a url which a rule blocks."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = scratch.save(ends, "alias-urls")
    n_nodes = nodes.count()
    if not n_nodes:
        return nodes.withColumnRenamed("id", "blocked")
    limit = fair_share(nodes, 2 * n_nodes)
    graph = index_graph(nodes, edges, scratch, limit)
    members = scratch.save(connected_components(graph, scratch, limit), "alias-classes")
    own = nodes.select(F.col("id").alias("key"), host_of(F.col("id")).alias("host"), url_part(F.col("id"), 3).alias("path"))
    refused = _match(own, rules, n_rules, n_nodes).where("NOT allow").select(F.col("key").alias("id"))
    classes = members.join(refused, "id", "left_semi").select(F.col("component").alias("class")).distinct()
    hot = find_hot(members, "component", n_nodes, limit)
    return lookup_join(members, "component", classes, "class", hot, "id", "left_semi").select(F.col("id").alias("blocked"))
