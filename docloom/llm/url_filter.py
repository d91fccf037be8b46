"""URL rules whose block decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, connected_components, materialize, read

#: Fixed rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[\d.]*\s*;\s*url\s*=\s*'?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What a URL names, whatever its scheme and fragment: host, path and query; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(url.contains("://"), F.concat(host_of(url), path, query))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as an absolute URL, read on the page ``base``."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), link))
        .otherwise(F.concat(folder, link))
    )


def links_of(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that a page's canonical link or refresh redirect declares to be the same."""
    base = pages.select("url", F.array(F.regexp_extract("html", _LINK, 1), F.regexp_extract("html", _REFRESH, 1)).alias("links"))
    found = base.select("url", F.explode(F.filter("links", lambda x: x != "")).alias("link"))
    return found.select(address_of(F.col("url")).alias("a"), address_of(resolved(F.col("url"), F.col("link"))).alias("b"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and what the longest fitting rule says: rule, by_rule; null where none fits.

    Each distinct address meets the rules by equality: its host's dot suffixes name the lengths of the paths that rules of
    that host have, and its own beginnings of those lengths name the rules. So a long rule list is joined, not scanned,
    and a host with very many rules sends none of them to its pages but those that fit.
    """
    lengths = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    at = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("rule_host"))
    begun = at.join(lengths, "rule_host").select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    begun = begun.withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    fitting = begun.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), ["rule_host", "rule_path"])
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"), "rule_host", "rule_path", "verdict")
    best = fitting.groupBy("host", "path").agg(F.max(order).alias("best"))
    said = best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.verdict").alias("by_rule"))
    return urls.join(said, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component of each row of ``pages(page_id, url, html)``.

    A page's own longest fitting rule decides. Without one, the page takes part in its class of aliases: addresses
    joined by canonical links and refresh redirects in ``html`` and by ``redirects(from_url, to_url)``, found as
    connected components. An explicit allow on any alias goes before a block on another; a block on an alias blocks;
    else the page is allowed. Addresses ignore scheme and fragment. ``component`` is the smallest address of a class,
    null for pages without aliases. Null urls and urls without ``://`` have an empty host and path and no aliases;
    null html has no links; repeated rows are judged alike; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    edges = links_of(pages.where("html is not null and url is not null"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address_of(F.col("from_url")).alias("a"), address_of(F.col("to_url")).alias("b")))
    nodes = materialize(connected_components(edges))
    split = nodes.select(
        "component", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")
    )
    said = ruled(split, rules).groupBy("component").agg(F.bool_or(F.col("by_rule") == "allow").alias("allowed"), F.bool_or(F.col("by_rule") == "block").alias("blocked"))
    fate = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    aliases = nodes.join(said, "component").select(F.col("node").alias("address"), "component", fate.alias("by_alias"))
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    return (
        ruled(base, rules)
        .join(aliases, "address", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_alias", F.lit("allow")).alias("verdict"), "component")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


OP9_SQL = r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
base AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM base),
q AS (SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)?', 1) END AS address FROM p),
found AS (SELECT address AS a, url, unnest([
    coalesce(nullif(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''), regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1)),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[\d.]*\s*;\s*url\s*=\s*''?([^"''\s>]+)', 1)]) AS link FROM q WHERE html IS NOT NULL AND url IS NOT NULL),
target AS (SELECT a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || link
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1) || link END AS b FROM found WHERE link <> ''),
pairs AS (SELECT a, lower(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1)) || CASE WHEN regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END || regexp_extract(b, '(?s)^[^?#]*(\?[^#]*)?', 1) AS b FROM target WHERE contains(b, '://')),
e AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
nodes AS (SELECT node, component, regexp_extract(node, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM comp),
judged AS (SELECT n.component, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM nodes n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.component, n.node),
fate AS (SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM judged GROUP BY 1),
best AS (SELECT host, path, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS verdict FROM (
    SELECT d.host, d.path, r.host || r.path AS r, r.verdict AS v FROM (SELECT DISTINCT host, path FROM q) d JOIN rules r ON (d.host = r.host OR ends_with(d.host, '.' || r.host)) AND starts_with(d.path, r.path)) GROUP BY 1, 2)
SELECT q.page_id, q.host, q.path, best.rule, coalesce(best.verdict, fate.verdict, 'allow') AS verdict, comp.component
FROM q LEFT JOIN best ON best.host = q.host AND best.path = q.path LEFT JOIN comp ON comp.node = q.address LEFT JOIN fate ON fate.component = comp.component
"""
