"""URL filter whose block decisions spread over redirect and canonical-link aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty
from .components import connected_components

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The fitting rule as struct(rule, verdict), or null: the longest by host and path together, allow first among equals.

    The rules are few and fixed, so they become one CASE expression, tested from the longest on.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def alias_key(url: Column) -> Column:
    """What identifies a page among aliases: host, path without a final slash, and query; the scheme and fragment don't count."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(url_host(url), F.regexp_replace(url_path(url), "/$", ""), query)


#: References that links are written with; `&amp;` is decoded last, so that nothing is decoded twice.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments (RFC 3986, 5.2.4); nothing goes above the root."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, ends), "/")


def resolved(url: Column, target: Column) -> Column:
    """A link's target as seen from the page (RFC 3986, 5.2.2); null for the page itself and for targets without a host."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root, path = F.concat(scheme, F.lit("://"), url_host(url)), url_path(url)
    before, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own = F.regexp_extract(target, r"(?s)^(.*?://[^/?#]*)", 1)
    return (
        F.when(target.contains("://") & target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(own, without_dots(url_path(target)), F.regexp_extract(target, r"(?s)^.*?://[^?#]*(.*)$", 1)))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when((target == "") | target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("/"), F.concat(root, without_dots(before), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, before)), rest))
    )


def link_targets(url: Column, html: Column) -> Column:
    """Targets of every `<link rel=canonical>` and meta refresh of a page outside comments, decoded and made absolute: an array of URLs."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    tags = lambda pattern: F.regexp_extract_all(plain, F.lit(pattern), 0)
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)
    links = F.transform(tags(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), lambda t: value(t, "href"))
    refreshes = F.transform(tags(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), lambda t: value(t, "url"))

    def decoded(target: Column) -> Column:
        for name, sign in ENTITIES:
            target = F.replace(target, F.lit(name), F.lit(sign))
        return target

    # The pages without either word skip both expressions.
    maybe = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    found = F.array_compact(F.transform(F.concat(links, refreshes), lambda x: resolved(url, decoded(x))))
    return F.when(maybe & url.contains("://"), found).otherwise(F.array().cast("array<string>"))


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of every redirect and canonical link that the pages state."""
    return pages.select(F.col("url"), F.explode(link_targets(F.col("url"), F.col("html"))).alias("target"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Judge every page's URL by `rules`, and by its aliases where no rule fits.

    pages: (page_id, url, html, ...); other columns are ignored.  edges: (url, target), redirect_edges(pages) if not given.
    URLs joined by redirects or canonical links, in either direction, are aliases (a connected component over alias keys).
    A URL that a rule fits keeps the rule's verdict: an explicit allow stands even among blocked aliases.  Any other URL is
    blocked if a rule blocks one of its aliases (target URLs count, though they may not be in `pages`); otherwise `default`.
    Returns page_id, host, path, rule (null where none fits), verdict, aliased (whether an alias decided), a row per row.
    A null URL, or one without `://`, has an empty host and path, fits no rule and has no alias.  Null html has no links.  Pages of any
    length are read whole; rows that repeat a page, or its id, are judged each by itself, and their links join one graph.
    Only linked URLs enter the graph: its size follows the number of links, not of pages.
    """
    judged = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("hit", rule_match(F.col("host"), F.col("path"), rules))
    edges = redirect_edges(pages) if edges is None else edges.select("url", "target")
    # Nodes are 64-bit hashes of alias keys.
    node = lambda c: F.xxhash64(alias_key(F.col(c)))
    keyed = edges.where("url is not null and target is not null").select("url", "target", node("url").alias("a"), node("target").alias("b")).where("a <> b")
    components = connected_components(keyed.select("a", "b"))
    if is_empty(components):
        spread = F.lit(False)
        decided = judged
    else:
        urls = keyed.select(F.col("url").alias("u"), F.col("a").alias("node")).union(keyed.select("target", "b"))
        urls = urls.select("node", rule_match(url_host(F.col("u")), url_path(F.col("u")), rules)["verdict"].alias("v")).where("v = 'block'")
        blocked = components.join(urls.select("node").distinct(), "node").select("component").distinct()
        tainted = components.join(blocked, "component", "left_semi").select(F.col("node").alias("tainted"))
        decided = judged.withColumn("node", F.when(F.col("hit").isNull() & (F.col("host") != ""), node("url"))).join(tainted, F.col("node") == F.col("tainted"), "left")
        spread = F.col("tainted").isNotNull()
    verdict = F.coalesce(F.col("hit.verdict"), F.when(spread, F.lit("block")).otherwise(F.lit(default)))
    return decided.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), (F.col("hit").isNull() & spread).alias("aliased"))
