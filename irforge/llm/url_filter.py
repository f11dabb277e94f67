"""URL filters with redirect equivalence.

A url's host and path meet the rules by an equi-join on every suffix of the host; the longest rule
that fits is the url's own.  Link targets are judged like the pages' own urls.  Urls without a rule take the decision of their aliases: connected
components run over redirect edges (a url to its usual redirect target: https, no www. or m. label,
no fragment, no tracking parameters, no closing slash or .html; and meta refreshes) and canonical-link
edges of the pages' html.  A component with an explicitly blocked alias is blocked for all aliases
without a rule, unless another alias is explicitly allowed: an explicit allow takes precedence.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and no aliases,
and is allowed; null html has no links; repeated rows are each judged; an empty table gives an empty
result.  Relative link targets count only if they begin with a slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irforge.llm.base import ascii_lower
from irforge.llm.components import connected_components
from irforge.session import materialize

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

CANONICAL = r"""(?i)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*url\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def redirect_target(url: Column) -> Column:
    """Where a url usually redirects to; null without ://."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref)(=|$)") & (p != "")), "&")
    return F.when(_rest(url).isNotNull(), F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, target) of the pages' canonical links and meta refreshes."""
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract("html", REFRESH, 1)
    found = pages.where(F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH)).select("url", F.explode(F.array(canonical, refresh)).alias("to"))
    absolute = F.when(F.instr("to", "://") > 0, F.col("to")).when(F.col("to").startswith("/"), F.concat(F.lit("https://"), host_of(F.col("url")), F.col("to")))
    return found.select("url", absolute.alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every page; rules(rule_host, rule_path, rule_verdict)."""
    url = F.col("url")
    links = link_targets(pages)
    urls = pages.select("url").where("url is not null").union(links.select("target")).distinct().select("url", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.where("host != ''").select("url", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host") \
        .where(F.col("path").startswith(F.col("rule_path"))).withColumn("rule", F.concat("rule_host", "rule_path"))
    own = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    own = materialize(urls.join(own, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("own")))
    edges = own.select(url.alias("a"), redirect_target(url).alias("b")) \
        .unionByName(links.select(url.alias("a"), F.col("target").alias("b")))
    member = own.join(connected_components(edges).withColumnRenamed("node", "url"), "url", "left") \
        .withColumn("component", F.coalesce("component", "url"))
    decided = member.where("own is not null").groupBy("component").agg(F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("blocked"), F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allowed"))
    passed_on = F.when((F.col("blocked") == 1) & (F.col("allowed") == 0), "block").otherwise("allow")
    judged = member.join(decided, "component", "left").select(url.alias("u"), "host", "path", "rule", F.coalesce("own", passed_on).alias("verdict"))
    out = pages.select("page_id", "url").join(judged, url == F.col("u"), "left")
    return out.select("page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, rule_table(spark)).drop("url")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
found AS (SELECT url, host, regexp_extract(regexp_extract(html, '<link\s[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*>', 0, 'i'), 'href\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS t FROM h
          UNION SELECT url, host, regexp_extract(html, '<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*url\s*=\s*["'']?([^"''\s>]+)', 1, 'i') FROM h),
links AS (SELECT url, CASE WHEN strpos(t, '://') > 0 THEN t WHEN starts_with(t, '/') THEN 'https://' || host || t END AS t FROM found),
src AS (SELECT url AS u FROM h WHERE url IS NOT NULL UNION SELECT t FROM links WHERE t IS NOT NULL),
cut AS (SELECT u, substr(u, strpos(u, '://') + 3) AS r FROM src WHERE strpos(u, '://') > 0),
canon AS (SELECT u, 'https://' || regexp_replace(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '')
                 || regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '(/|\.html)$', '') AS base,
                 array_to_string(list_filter(string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)') AND x <> ''), '&') AS q FROM cut),
split AS (SELECT u AS url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
own AS (SELECT url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
        FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
e AS (SELECT u AS a, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS b FROM canon UNION SELECT url, t FROM links WHERE url IS NOT NULL AND t IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, reach.root FROM reach JOIN s ON s.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
decided AS (SELECT c, max((rv = 'block')::INT) AS blocked, max((rv = 'allow')::INT) AS allowed FROM own JOIN comp ON node = url GROUP BY c)
SELECT page_id, host, path, rule, CASE WHEN rv IS NOT NULL THEN rv WHEN blocked = 1 AND allowed = 0 THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN own USING (url) LEFT JOIN comp ON node = h.url LEFT JOIN decided USING (c)
"""
