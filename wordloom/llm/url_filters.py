"""URL filters with redirect equivalence.

A rule has a host, a path prefix and a verdict. It fits its host and all subdomains of it, for paths
that start with its path; of the rules that fit a url the longest (host and path together)
decides, then the one with the longer host, then allow before block. Urls that are
aliases of one another, by a canonical link or a redirect (``meta`` refresh) of their page,
form a component. A block decided for any url of a component by a rule reaches
all its urls that no rule decides; a url with a rule of its own keeps that rule's
verdict, so an explicit allow stands against a block that comes in from aliases.
A page may also come with a redirect target of its own in a column.

Rules are joined on the suffixes of the distinct hosts and paths, never tried one by one; aliases meet
by distributed connected components over the pages that have links. Only DataFrame functions.

All canonical and refresh tags of a page count, with character references in their targets decoded.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and
no aliases: allow. Repeated rows are judged alike. Null html has no links. No rules:
everything is allowed. Fragments do not tell urls apart. Kept columns named like
those of the result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.html import decode_entities
from wordloom.llm.graph import components
from wordloom.llm.tables import shared

#: Columns of the result; kept columns of these names give way to them.
NEW = {"host", "path", "rule", "verdict", "blocked_alias"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# A tag ends at the next bracket, so that unclosed tags take linear time.
CANONICAL = r"(?i)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>"
REFRESH = r"(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s<>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without its fragment, its scheme and host in lower case; null if it has no host."""
    head = F.translate(F.regexp_extract(url, r"^[^/?#]*?://[^/?#]*", 0), UPPER, LOWER)
    bare = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    return F.when(head != "", F.concat(head, F.substr(bare, F.length(head) + 1)))


def absolute(link: Column, base: Column) -> Column:
    """A link as a url: with a scheme, a host, a path from the root, or a path from the page."""
    scheme = F.regexp_extract(base, r"^([^/?#]*?:)//", 1)
    site = F.regexp_extract(base, r"^[^/?#]*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^/?#]*?://[^/?#]*(/(?:[^?#]*/)?)?", 0)
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link))
    )


def _named(html: Column, tag: str, target: str) -> Column:
    """What all tags of a kind name, as written."""
    tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
    found = F.coalesce(F.transform(tags, lambda x: F.regexp_extract(x, target, 1)), F.array().cast("array<string>"))
    return F.array_distinct(found)


def links(pages: DataFrame, url: str = "url", html: str = "html", redirect: str | None = None) -> DataFrame:
    """``u``, ``v``: a page's node and the node it names as canonical or redirects to."""
    base = F.regexp_extract(F.col(url), r"(?s)^[^#]*", 0)
    targets = F.array_union(_named(F.col(html), CANONICAL, HREF), _named(F.col(html), REFRESH, TARGET))
    rows = pages.select(base.alias("base"), F.explode(targets).alias("link"))
    rows = rows.withColumn("link", decode_entities(F.col("link")))
    if redirect:
        rows = rows.unionAll(pages.select(base, F.col(redirect)))
    rows = rows.where("base is not null and link <> ''")
    return rows.select(
        node_of(F.col("base")).alias("u"), node_of(absolute(F.col("link"), F.col("base"))).alias("v")
    ).where("u is not null and v is not null")


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` (each pair once), ``rule``, ``rule_verdict`` where some rule fits."""
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    each = pairs.select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "allow")
    pick = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order)
    return fits.groupBy("host", "path").agg(pick.alias("x")).select(
        "host", "path", F.col("x.rule").alias("rule"), F.col("x.verdict").alias("rule_verdict"))


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html",
    redirect: str | None = None, keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``verdict``, ``blocked_alias`` for every page."""
    edges = shared(links(pages, url, html, redirect), "links")
    groups = shared(components(edges), "aliases")
    named = groups.select(
        "node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    blocked = (
        named.join(decide(named, rules), ["host", "path"])
        .where(F.col("rule_verdict") == "block")
        .select("component")
        .distinct()
    )
    tainted = groups.join(blocked, "component", "left_semi").select("node")
    own = pages.select(
        *[F.col(c).alias(f"keep{k}__") for k, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        node_of(F.col(url)).alias("node"))
    out = own.join(decide(own, rules), ["host", "path"], "left").join(
        tainted.withColumn("tainted", F.lit(True)), "node", "left")
    alias = F.coalesce(F.col("tainted"), F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(alias, F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col(f"keep{k}__").alias(c) for k, c in enumerate(keep) if c.lower() not in NEW]
    return out.select(*kept, "host", "path", "rule", verdict.alias("verdict"), alias.alias("blocked_alias"))
