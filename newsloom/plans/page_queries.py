"""Registered queries on pages, texts, names and keyword subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import alerts as K
from newsloom.plans import adapters as T
from newsloom.plans.registry import query
from newsloom.sources import pages as P

_BARE = "regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs')"
for _tag in P.CHROME:
    _BARE = f"regexp_replace({_BARE}, '<{_tag}(\\s[^>]*)?>.*?</{_tag}\\s*>', '', 'gis')"
_TEXT = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g'))"
_URL = """CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#@]+([/?#]|$)') AND length(url) <= 1000 THEN
  lower(regexp_extract(url, '^([A-Za-z]+://)', 1)) || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'https%' THEN ':443$' ELSE ':80$' END, '')
  || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '^[A-Za-z]+://[^/?#]*[^?#]*(\\?[^#]*)?', 1) END"""


@query(
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, 'is')) AS href, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2, 'is')) AS raw,
  generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, 'is'), 1) AS pos FROM pages), t AS (SELECT page_id, href, pos, {_TEXT.format("raw")} AS label FROM l)
SELECT page_id, href, arg_min(label, pos) AS label FROM t WHERE href <> '' AND length(label) BETWEEN 1 AND 500 GROUP BY page_id, href"""
)
def harvest_links(spark, sf_dir):
    return P.harvest_links(T.read(spark, sf_dir, "pages"))


@query(
    f"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(regexp_extract_all({_BARE}, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 'is'), lambda p: {_TEXT.format("p")}), lambda p: length(p) > 30), chr(10) || chr(10)), '') AS content FROM pages"""
)
def detail_paragraphs(spark, sf_dir):
    return P.detail_paragraphs(T.read(spark, sf_dir, "pages"))


@query(
    f"""WITH c AS (SELECT page_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all({_BARE}, '<a\\s[^>]*>(.*?)</a>', 1, 'is'), lambda x: length({_TEXT.format("x")}))), 0) AS INTEGER) AS n_link, CAST(length({_TEXT.format(_BARE)}) AS INTEGER) AS n_text FROM pages)
SELECT *, n_link > n_text * 0.35 AS noisy FROM c"""
)
def link_density(spark, sf_dir):
    return P.link_density(T.read(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {_URL} AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", P.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT min(page_id) AS page_id, {_URL} AS canonical, count(*) - 1 AS n_later FROM pages WHERE {_URL} IS NOT NULL GROUP BY 2")
def dedup_by_url(spark, sf_dir):
    rows = T.read(spark, sf_dir, "pages").select("page_id", P.canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")
    return rows.groupBy("canonical").agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("n_later"))


_HOST, _PATH = "regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)", "regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(
    f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM (SELECT page_id, {_URL} AS u FROM pages)),
t AS (SELECT host, regexp_extract(path, '^(/[^/]*)', 1) AS prefix, min(page_id) AS template_id FROM p WHERE path <> '' GROUP BY 1, 2 UNION ALL SELECT host, '/', -min(page_id) - 1 FROM p WHERE path <> '' GROUP BY host),
m AS (SELECT page_id, template_id, prefix FROM p JOIN t ON p.host = t.host AND starts_with(path, prefix) QUALIFY rank() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) = 1)
SELECT page_id, min(template_id) AS template_id, min(prefix) AS prefix FROM m GROUP BY page_id HAVING count(*) = 1"""
)
def match_template(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages")
    url = P.canonical_url(F.col("url"))
    split = pages.select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")).where("path <> ''")
    deep = split.groupBy("host", F.regexp_extract("path", r"^(/[^/]*)", 1).alias("prefix")).agg(F.min("page_id").alias("template_id"))
    flat = split.groupBy("host").agg((-F.min("page_id") - 1).alias("template_id")).select("host", F.lit("/").alias("prefix"), "template_id")
    return P.match_template(pages, deep.unionByName(flat))


_FIRST = "lower(regexp_extract(text, '([A-Za-z]{9,})', 1))"


@query(
    f"""WITH s AS (SELECT conv_id AS user_id, turn AS subscription_id, {_FIRST} AS keyword FROM conversations WHERE {_FIRST} <> ''),
m AS (SELECT user_id, doc_id AS article_id, keyword, subscription_id FROM s JOIN documents ON contains(lower(text), keyword))
SELECT user_id, article_id, arg_min(keyword, subscription_id) AS keyword FROM m GROUP BY user_id, article_id"""
)
def keyword_matches(spark, sf_dir):
    word = F.lower(F.regexp_extract("text", "([A-Za-z]{9,})", 1))
    subs = T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("subscription_id"), word.alias("keyword"))
    return K.keyword_matches(subs, T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"))


@query(
    f"""WITH s AS (SELECT conv_id AS user_id, {_FIRST} AS keyword FROM conversations WHERE {_FIRST} <> ''),
m AS (SELECT DISTINCT user_id, doc_id FROM s JOIN documents ON contains(lower(text), keyword))
SELECT user_id, count(*) AS n_articles, max(doc_id) AS last_article FROM m GROUP BY user_id"""
)
def keyword_alerts(spark, sf_dir):
    return K.keyword_alerts(keyword_matches(spark, sf_dir))


@query(None)
def slug(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.slug(F.concat("source", F.lit(" "), F.coalesce("text", F.lit("")))).alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY' WHEN regexp_matches(lower(p_type), '(^|[^a-z])widget') THEN 'Widgets' ELSE 'Other' END AS \"group\" FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || ' ' || p_name END AS p_type FROM part)")
def sector_group(spark, sf_dir):
    sector = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return T.read(spark, sf_dir, "part").select("p_partkey", X.sector_group(sector, {"ECONOMY": [], "Widgets": ["widget", "widge"]}).alias("group"))


@query(None)
def strip_html(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(None)
def body_matches_title(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    pages = T.read(spark, sf_dir, "pages")
    body = P.detail_paragraphs(pages).select("page_id", "content")
    return pages.select("page_id", title.alias("title")).join(body, "page_id").select("page_id", X.body_matches_title(F.col("title"), F.col("content")).alias("matches"))
