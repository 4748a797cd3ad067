"""Registered queries on feeds, crawling rules and the content of pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.plans import adapters as T
from newsloom.plans.page_queries import _BARE, _TEXT
from newsloom.plans.registry import query
from newsloom.sources import content, feeds, robots


def customer_feeds(spark, sf_dir):
    """Feeds of at most 40 customers each; every seventh has no title, every ninth no id, each eleventh feed breaks off, each thirteenth is empty."""
    c = T.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    link = F.concat(F.lit("https://example.org/c/"), k.cast("string"))
    item = F.concat(
        F.lit("<item>"),
        F.when(k % 7 == 0, "").otherwise(tag("title", F.concat(F.lit(" "), F.col("c_name")))),
        tag("link", link),
        F.when(k % 9 == 0, "").otherwise(tag("guid", F.concat(F.lit("id-"), k.cast("string")))),
        tag("description", F.concat(F.lit("<![CDATA["), F.col("c_mktsegment"), F.lit("]]>"))),
        F.lit("<pubDate>Tue, 03 Jul 2001 10:20:30 +0200</pubDate></item>"),
    )
    feed = F.floor(k / 40).cast("long").alias("feed_id")
    listed = c.groupBy(feed).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Customers</title>'), F.when(F.col("feed_id") % 13 == 0, "").otherwise(F.col("items")), F.when(F.col("feed_id") % 11 == 10, "<item><title>cut").otherwise("</channel></rss>"))
    return listed.select("feed_id", body.alias("body"))


_GROUPS = "SELECT CAST(floor(c_custkey / 40) AS BIGINT) AS feed_id, c_custkey AS k, c_name, c_mktsegment FROM customer"


@query(
    f"""WITH c AS ({_GROUPS}), p AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY k) - 1 AS pos FROM c WHERE feed_id % 13 <> 0 AND feed_id % 11 <> 10)
SELECT feed_id, CAST(pos AS INTEGER) AS position, trim(c_name) AS title, 'https://example.org/c/' || k AS url,
  CASE WHEN k % 9 = 0 THEN substr(sha256('https://example.org/c/' || k), 1, 32) ELSE 'id-' || k END AS external_id, c_mktsegment AS content, TIMESTAMP '2001-07-03 08:20:30' AS published_at FROM p WHERE k % 7 <> 0"""
)
def scan_feed(spark, sf_dir):
    return feeds.scan_feed(customer_feeds(spark, sf_dir)).drop("author", "image_url")


@query(
    f"""WITH c AS ({_GROUPS}) SELECT feed_id, CASE WHEN feed_id % 11 = 10 THEN 'malformed' WHEN feed_id % 13 = 0 THEN 'empty' ELSE 'items' END AS status,
  CAST(CASE WHEN feed_id % 11 = 10 OR feed_id % 13 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS n_items FROM c GROUP BY feed_id"""
)
def feed_status(spark, sf_dir):
    return feeds.feed_status(customer_feeds(spark, sf_dir))


def supplier_robots(spark, sf_dir):
    """Rules of one host for each supplier; every tenth text is malformed."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    body = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /c"), text(k % 3), F.lit("\nAllow: /c"), text(k % 3), F.lit("/*5$\nCrawl-delay: "), text(k % 4),
        F.when(k % 5 == 0, "\nUser-agent: loombot\nUser-agent: other\nDisallow: /*7\nAllow: /c1").otherwise(""), F.when(k % 10 == 9, "\nno colon").otherwise("\nSitemap: https://example.org/map"),
    )
    return T.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text(k), F.lit(".example.org")).alias("host"), body.alias("body"))


def order_urls(spark, sf_dir):
    l = T.read(spark, sf_dir, "lineitem")
    return l.select(F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.org/c"), (F.col("l_orderkey") % 3).cast("string"), F.lit("/"), F.col("l_orderkey").cast("string")).alias("url")).distinct()


_OWN = "(k % 5 = 0)"
_HOSTS = "SELECT s_suppkey AS k, 's' || s_suppkey || '.example.org' AS host FROM supplier"


@query(
    f"""WITH h AS ({_HOSTS}) SELECT host, k % 10 <> 9 AS available, CASE WHEN k % 10 <> 9 THEN CAST(CASE WHEN {_OWN} THEN 0 ELSE k % 4 END AS DOUBLE) END AS delay,
  CASE WHEN k % 10 = 9 THEN 0 ELSE 2 END AS n_rules FROM h"""
)
def scan_robots(spark, sf_dir):
    return robots.robots_rules(supplier_robots(spark, sf_dir), "LoomBot").select("host", "available", "delay", F.size("rules").alias("n_rules"))


@query(
    f"""WITH h AS ({_HOSTS}), u AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS o FROM lineitem)
SELECT 'https://' || host || '/c' || (o % 3) || '/' || o AS url, host, k % 10 <> 9 AS available, CASE WHEN k % 10 <> 9 THEN CASE WHEN {_OWN} THEN o % 3 = 1 OR NOT contains('/c' || (o % 3) || '/' || o, '7')
  ELSE o % 3 <> k % 3 OR o % 10 = 5 END END AS allowed FROM u JOIN h USING (k)"""
)
def robots_allowed(spark, sf_dir):
    return robots.robots_allowed(order_urls(spark, sf_dir), robots.robots_rules(supplier_robots(spark, sf_dir), "LoomBot"))


_ALL = _TEXT.format(_BARE)


@query(f"SELECT page_id, substr({_ALL}, 1, 5000) AS excerpt, length({_ALL}) < 200 AS too_thin FROM pages")
def website_excerpt(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", content.website_excerpt(F.col("html")).alias("x")).select("page_id", "x.*")


@query(
    f"""WITH c AS (SELECT page_id, regexp_matches(html, '<[a-zA-Z/!]') AS markup, {_ALL} AS visible, html,
  coalesce(list_sum(list_transform(regexp_extract_all({_BARE}, '<a\\s[^>]*>(.*?)</a>', 1, 'is'), lambda x: length({_TEXT.format("x")}))), 0) > length({_ALL}) * 0.35 AS noisy,
  list_filter(list_transform(regexp_extract_all({_BARE}, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 'is'), lambda p: {_TEXT.format("p")}), lambda p: p <> '') AS ps FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN NOT markup THEN array_to_string(list_filter(list_transform(string_split(html, chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10))
  WHEN NOT noisy THEN CASE WHEN len(ps) > 0 THEN array_to_string(ps, chr(10) || chr(10)) ELSE visible END END AS text, CASE WHEN markup AND noisy THEN 'low_quality' END AS error FROM c"""
)
def clean_content(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", content.clean_content(F.col("html")).alias("x")).select("page_id", "x.*")


@query(None)
def resolve_url(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages")
    links = pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("href"))
    return links.select("page_id", "href", content.resolve_url(F.col("url"), F.col("href")).alias("resolved"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'not_retained' WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'expired' WHEN o_custkey % 4 = 0 OR c_custkey IS NULL THEN 'unavailable' ELSE 'available' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def evidence_status(spark, sf_dir):
    name = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    captures = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.sha2(name, 256)).alias("body_hash"), F.date_add(F.to_date("o_orderdate"), 0).cast("timestamp").alias("expires_at"))
    kept = F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"))
    bodies = T.read(spark, sf_dir, "customer").select(F.sha2(kept, 256).alias("body_hash"), F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(kept).alias("body"))
    return content.evidence_status(captures, bodies, datetime(1996, 1, 1))


@query(
    """WITH e AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS source_id, lower(p_name) AS name FROM part), k AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 3 = 0)
SELECT source_id, count(*) AS n_entries, count(*) FILTER (k.name IS NULL) AS n_new FROM e LEFT JOIN k USING (name) GROUP BY source_id"""
)
def discovery_report(spark, sf_dir):
    part = T.read(spark, sf_dir, "part")
    return content.discovery_report(part.select(F.col("p_size").cast("long").alias("source_id"), F.upper("p_name").alias("name")), part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")))
