"""URL filters: host and path rules, and redirect equivalence for urls that no rule names. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, split_join, written
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host and a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Targets that a page states about itself: a canonical link or a refresh to another address.
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does. The rules are a list in the program."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def canonical_form(url: Column) -> Column:
    """The address without scheme, ``www.``, query, fragment and a last slash: aliases that differ only there are one page."""
    host, path = host_of(url), path_of(url)
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def without_dots(path: Column) -> Column:
    """``path``, which begins with a slash, without its segments ``.`` and ``..``."""
    part = F.slice(F.split(path, "/"), 2, 1 << 30)
    part = F.when(F.element_at(part, -1).isin(".", ".."), F.concat(part, F.array(F.lit("")))).otherwise(part)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(part, F.array().cast("array<string>"), step), "/"))


def resolved(url: Column, target: Column) -> Column:
    """The address that ``target`` means on the page ``url``; null for other schemes, as ``mailto:``, and pages without a host."""
    scheme, host, own = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, _PARTS, 1), path_of(url)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    path = (
        F.when(path == "", own)
        .when(path.startswith("/"), without_dots(path))
        .otherwise(without_dots(F.concat(F.coalesce(F.nullif(F.regexp_extract(own, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), path)))
    )
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(scheme, F.lit("://"), host, path, rest))
    )


def stated_targets(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): all canonical links and refresh redirects in the pages' own html, relative ones resolved against the page's address."""
    text = F.col(html)
    hints = F.lower(text)
    page = pages.select(F.col(url).alias("source"), F.col(html).alias("html")).where(F.col(url).isNotNull() & (hints.contains("canonical") | hints.contains("http-equiv")))
    every = [F.regexp_extract_all("html", F.lit(e), F.lit(1)) for e in (_CANONICAL, _REFRESH)]
    found = page.select("source", F.explode(F.concat(*every)).alias("target"))
    return found.select("source", resolved(F.col("source"), F.col("target")).alias("target")).where("target is not null")


def _joined(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """A left join with a table of one row a key: by broadcast within the bound, else with hot keys split off."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    return split_join(written(left, what), right, key, "left")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, and component (null without an alias) for every row of ``pages``.

    A url that a rule fits has the rule's verdict. Any other takes its component's: links between addresses are
    ``redirects`` (source, target), canonical links and refreshes in the html, and the canonical form of an
    address. A component with an address that is explicitly allowed is allowed, else one with a blocked address
    is blocked, else ``default`` holds. Null urls and urls without ``://`` have empty host and path, no rule and
    the default; repeated rows are judged alike; an empty table gives an empty result. Other columns of the
    table are not looked at.
    """
    base = pages.select(pages[f"`{key}`"].alias("page_id"), pages[f"`{url}`"].alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))

    stated = stated_targets(pages, url, html)
    if redirects is not None:
        stated = stated.union(redirects.select("source", "target"))
    # Nodes are canonical forms, by a 128-bit digest. An address is its canonical form's alias without any
    # shuffle; only stated links between different forms need components.
    node = lambda c: F.when(host_of(F.col(c)) != "", F.md5(canonical_form(F.col(c))))
    links = written(stated.select(node("source").alias("a"), node("target").alias("b"), "source", "target"), "url-links")
    roots = connected_components(links)
    base = base.withColumn("node", F.when(F.col("host") != "", F.md5(canonical_form(F.col("url"))))).drop("url")
    # A page's address may be there under any number of queries: hot nodes and components meet a broadcast.
    named = _joined(base, roots, "node", "url-base").withColumn("component", F.coalesce("root", "node")).drop("root")

    # What the rules say of the component's addresses: pages' own, and those that links only name.
    ends = links.select(F.explode(F.array("source", "target")).alias("url")).where("url is not null")
    ends = ends.withColumn("node", node("url")).where("node is not null")
    ends = ends.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    ends = ends.withColumn("hit", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules))
    said = named.select("component", "hit").union(ends.select("component", "hit")).where("hit is not null and component is not null")
    said = written(said.groupBy("component").agg(F.min("hit.verdict").alias("said")), "url-said")  # 'allow' sorts before 'block'
    open_rows = _joined(named.where("hit is null"), said, "component", "url-open").withColumn("verdict", F.coalesce("said", F.lit(default))).drop("said")
    ruled = named.where("hit is not null").withColumn("verdict", F.col("hit.verdict"))
    return ruled.unionByName(open_rows).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), "verdict", "component")
