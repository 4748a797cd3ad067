"""Registered queries of readers' lists and of rules that rows must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import contracts as V
from newsloom.operators import reader as R
from newsloom.operators.ledgers import CLOSED
from newsloom.plans import adapters as T
from newsloom.plans.adapters import AS_OF, RUNS_AS_OF, with_tables
from newsloom.plans.registry import query

_TITLED = """titled AS (SELECT doc_id AS id, doc_id % 20 AS source_id, doc_id % 3 = 0 AS processed, substring(text, 1, 80) AS title_fr, CASE WHEN doc_id % 2 = 0 THEN lang END AS title_zh, CASE WHEN doc_id % 5 = 0 THEN upper(substring(text, 81, 40)) END AS title_en FROM documents)"""
_LOW = "contains(lower(strip_accents({0})), '{1}')"


def titled(spark, sf_dir):
    k, text = F.col("doc_id"), F.col("text")
    return T.read(spark, sf_dir, "documents").select(k.alias("id"), (k % 20).alias("source_id"), (k % 3 == 0).alias("processed"), F.substring(text, 1, 80).alias("title_fr"), F.when(k % 2 == 0, F.col("lang")).alias("title_zh"), F.when(k % 5 == 0, F.upper(F.substring(text, 81, 40))).alias("title_en"))


@query(f"WITH {_TITLED} SELECT id, source_id FROM titled WHERE source_id < 20 AND ({_LOW.format('title_fr', 'ent')} OR {_LOW.format('title_zh', 'ent')})")
def search_articles_api(spark, sf_dir):
    return R.search_articles_api(titled(spark, sf_dir), "Ént").select("id", "source_id")


@query(with_tables("companies", "mentions") + " SELECT id, name, count(article_id) AS n_articles FROM companies LEFT JOIN mentions ON company_id = id WHERE contains(lower(name), '0003') GROUP BY id, name")
def search_companies_api(spark, sf_dir):
    return R.search_companies_api(T.companies(spark, sf_dir), T.mentions(spark, sf_dir), "0003").select("id", "name", "n_articles")


@query(f"WITH {_TITLED} SELECT id FROM titled WHERE NOT processed AND ({_LOW.format('title_fr', 'ch')} OR {_LOW.format('title_zh', 'ch')} OR {_LOW.format('title_en', 'ch')})")
def admin_articles(spark, sf_dir):
    return R.admin_articles(titled(spark, sf_dir), processed=False, term="CH").select("id")


@query(with_tables("companies") + " SELECT id, name, (SELECT count(*) FROM companies WHERE review_status = 'pending') AS n_pending FROM companies WHERE review_status = 'approved' AND contains(lower(name), '1')")
def admin_companies(spark, sf_dir):
    return R.admin_companies(T.companies(spark, sf_dir), "approved", "1").select("id", "name", "n_pending")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0")
def active_sources(spark, sf_dir):
    k = F.col("s_suppkey")
    return R.active_sources(T.read(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (k % 4 != 0).alias("is_active"))).select("id", "name")


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS language, CASE doc_id % 3 WHEN 0 THEN 'z' || doc_id WHEN 1 THEN '' END AS title_zh, CASE WHEN doc_id % 5 = 0 THEN 'e' || doc_id END AS title_en, CASE WHEN doc_id % 7 > 0 THEN lang END AS title_fr FROM documents)
SELECT doc_id, coalesce(nullif(CASE language WHEN 'zh' THEN title_zh WHEN 'en' THEN title_en END, ''), title_fr, '') AS title FROM t""")
def localize(spark, sf_dir):
    k = F.col("doc_id")
    language = F.when(k % 4 == 0, "zh").when(k % 4 == 1, "en").when(k % 4 == 2, "fr")
    rows = T.read(spark, sf_dir, "documents").select(k, language.alias("language"), F.when(k % 3 == 0, F.concat(F.lit("z"), k)).when(k % 3 == 1, "").alias("title_zh"), F.when(k % 5 == 0, F.concat(F.lit("e"), k)).alias("title_en"), F.when(k % 7 > 0, F.col("lang")).alias("title_fr"))
    return rows.select("doc_id", R.localized("title", F.col("language")).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS overview, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_brand] ELSE [p_name] END, ',') AS names FROM part")
def best_overview(spark, sf_dir):
    k = F.col("p_partkey")
    overview = R.best_overview(F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, ""), F.when(k % 5 > 0, F.col("p_brand")))
    return T.read(spark, sf_dir, "part").select(k, overview.alias("overview"), F.array_join(R.all_names(F.col("p_name"), F.when(k % 2 == 0, F.array("p_brand"))), ",").alias("names"))


def categories(spark, sf_dir):
    return T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.concat(F.lit("c"), F.col("l_partkey") % 7).alias("category"))


@query(
    with_tables("articles", "mentions", "companies")
    + """, c AS (SELECT article_id, string_agg(company_id || ':' || name || ':' || coalesce(sentiment, ''), ',' ORDER BY company_id) AS companies FROM mentions JOIN companies ON id = company_id GROUP BY article_id),
g AS (SELECT l_orderkey AS article_id, string_agg(DISTINCT 'c' || (l_partkey % 7), ',' ORDER BY 'c' || (l_partkey % 7)) AS categories FROM lineitem GROUP BY l_orderkey)
SELECT id, coalesce(companies, '') AS companies, coalesce(categories, '') AS categories FROM articles LEFT JOIN c ON c.article_id = id LEFT JOIN g ON g.article_id = id"""
)
def article_detail(spark, sf_dir):
    out = R.article_detail(T.articles(spark, sf_dir), T.mentions(spark, sf_dir), T.companies(spark, sf_dir), categories(spark, sf_dir))
    told = F.transform("companies", lambda c: F.concat(c["company_id"], F.lit(":"), c["name"], F.lit(":"), F.coalesce(c["sentiment"], F.lit(""))))
    return out.select("id", F.array_join(told, ",").alias("companies"), F.array_join("categories", ",").alias("categories"))


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 7 = 3")
def articles_with_category(spark, sf_dir):
    return R.articles_with_category(T.articles(spark, sf_dir), categories(spark, sf_dir), "c3").select("id")


@query(
    """SELECT o_orderkey AS id, json_object('id', o_orderkey, 'url', 'https://news.example/' || o_orderkey, 'title_fr', o_orderpriority, 'author', CASE WHEN o_orderkey % 2 = 0 THEN 'a "b"' END,
  'published_at', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'llm_processed', o_orderstatus = 'F', 'content_level', CASE o_orderkey % 3 WHEN 0 THEN 'full' ELSE 'unknown' END, 'source_language', 'unknown')::VARCHAR AS document FROM orders"""
)
def api_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = T.read(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("https://news.example/"), k).alias("url"), F.col("o_orderpriority").alias("title_fr"), F.when(k % 2 == 0, 'a "b"').alias("author"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        (F.col("o_orderstatus") == "F").alias("processed"), F.when(k % 3 == 0, "full").when(k % 3 == 1, "").alias("content_level"), F.lit(None).cast("string").alias("source_language"),
    )
    return rows.select("id", R.article_document().alias("document"))


_DIGEST = (
    with_tables("articles")
    + """, a AS (SELECT *, coalesce(list_max(list_transform(highlights, lambda t: CASE t WHEN 'tech_breakthrough' THEN 4 WHEN 'local_research' THEN 3 WHEN 'investment' THEN 2 WHEN 'local_event' THEN 1 ELSE 0 END)), 0) AS score
  FROM articles WHERE published_at BETWEEN TIMESTAMP '2001-07-25' AND TIMESTAMP '2001-08-01'),
d AS (SELECT language, CASE WHEN score > 0 THEN 'top' ELSE 'rest' END AS section, CAST(row_number() OVER (PARTITION BY language, score > 0 ORDER BY score DESC, published_at DESC, id DESC) AS INTEGER) AS rank,
  id, CASE WHEN language = 'zh' AND id % 2 = 0 THEN 'z' || id ELSE 'f' || id END AS title FROM a, (SELECT unnest(['zh', 'en', 'fr']) AS language))"""
)


def _digest(spark, sf_dir):
    """The articles of a week in each language, and the readers of the digest."""
    a, k = F.col("id"), F.col("c_custkey")
    articles = T.articles(spark, sf_dir).withColumns({"crawled_at": F.col("published_at"), "title_fr": F.concat(F.lit("f"), a), "title_zh": F.when(a % 2 == 0, F.concat(F.lit("z"), a)), "title_en": F.lit("")})
    readers = T.read(spark, sf_dir, "customer").select(k.alias("user_id"), (k % 3 != 0).alias("is_active"), (k % 5 != 0).alias("wants_digest"), F.when(k % 4 == 1, "en").when(k % 4 == 2, "fr").when(k % 4 == 3, "zh").alias("language"))
    return R.daily_digest(articles, AS_OF, hours=168), readers


#: What every reader gets: the lists of each language once, and each reader with the language whose lists these are.
_READERS = """SELECT c_custkey AS user_id, language, n_articles FROM customer JOIN n ON language = CASE c_custkey % 4 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'zh' END WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0"""


@query(
    _DIGEST
    + f""", n AS (SELECT language, count(*) AS n_articles FROM d GROUP BY language)
SELECT language, section, rank, id, title, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS n_articles FROM d UNION ALL SELECT language, 'reader', NULL, NULL, NULL, user_id, n_articles FROM ({_READERS})"""
)
def daily_digest(spark, sf_dir):
    return R.digest_with_readers(*_digest(spark, sf_dir))


@query(
    _DIGEST
    + """, n AS (SELECT language, count(*) AS n_articles FROM d GROUP BY language)
SELECT c_custkey AS user_id, language, n_articles FROM customer JOIN n ON language = CASE c_custkey % 4 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'zh' END WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0"""
)
def digest_readers(spark, sf_dir):
    return R.digest_readers(*_digest(spark, sf_dir))


@query(
    with_tables("articles", "companies", "usage")
    + """ SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 4 <> 0) AS n_sources, count(*) AS n_articles, count(*) FILTER (NOT processed) AS n_unprocessed, (SELECT count(*) FROM companies) AS n_companies,
  (SELECT count(*) FROM companies WHERE is_map) AS n_map, (SELECT CAST(sum(cost_cents) AS BIGINT) FROM usage WHERE created_at BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-30 12:00:00') AS cost_today FROM articles"""
)
def dashboard(spark, sf_dir):
    sources = T.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4 != 0).alias("is_active"))
    return R.dashboard(T.articles(spark, sf_dir), T.companies(spark, sf_dir), sources, T.usage(spark, sf_dir), RUNS_AS_OF)


@query("SELECT role AS state, count(*) AS n FROM conversations GROUP BY role")
def job_counts(spark, sf_dir):
    return R.job_counts(T.read(spark, sf_dir, "conversations").select(F.col("role").alias("state")))


@query(
    """SELECT c_custkey AS source_id FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND TIMESTAMP '2024-01-01' + to_hours(c_custkey) <= TIMESTAMP '2024-01-30 12:00:00'
  AND (c_custkey % 3 <> 0 OR TIMESTAMP '2024-01-02' + to_hours(c_custkey) <= TIMESTAMP '2024-01-30 12:00:00') ORDER BY c_custkey LIMIT 50"""
)
def due_sources(spark, sf_dir):
    k = F.col("c_custkey")
    due = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=k.cast("int"))
    states = T.read(spark, sf_dir, "customer").select(k.alias("source_id"), (k % 4 != 0).alias("is_active"), F.when(k % 7 == 0, due).alias("paused_at"), due.alias("next_due_at"), F.when(k % 3 == 0, "held").alias("claim_id"), (due + F.expr("interval 1 day")).alias("lease_expires_at"))
    return R.due_sources(states, RUNS_AS_OF).select("source_id")


@query(with_tables("reservations") + " SELECT id, state FROM reservations ORDER BY state IN ('settled', 'reconciled'), day DESC, id DESC LIMIT 100")
def reservation_list(spark, sf_dir):
    return R.reservation_list(T.reservations(spark, sf_dir).withColumn("created_at", F.col("day")), CLOSED).select("id", "state")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 0 AND (s_suppkey % 5 = 0 OR TIMESTAMP '2024-01-20' + to_hours(CAST(s_suppkey * 6 AS BIGINT)) < TIMESTAMP '2024-01-29 12:00:00')")
def stale_list(spark, sf_dir):
    k = F.col("s_suppkey")
    last = F.lit("2024-01-20").cast("timestamp") + F.make_dt_interval(hours=(k * 6).cast("int"))
    return R.stale_list(T.read(spark, sf_dir, "supplier").select(k.alias("id"), (k % 4 != 0).alias("is_active"), F.when(k % 5 != 0, last).alias("last_crawled_at")), RUNS_AS_OF).select("id")


@query(with_tables("crawl_runs") + " SELECT id, source_id FROM crawl_runs ORDER BY started_at DESC, id DESC LIMIT 20")
def recent_lists(spark, sf_dir):
    return R.recent(T.crawl_runs(spark, sf_dir), "started_at", 20).select("id", "source_id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END NULLS FIRST, s_suppkey LIMIT 50")
def directories_to_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    return R.directories_to_scan(T.read(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3 != 0).alias("is_active"), F.when(k % 5 > 0, F.col("s_nationkey")).alias("last_scanned_at"))).select("id")


@query(
    with_tables("articles", "mentions")
    + """, r AS (SELECT company_id, CASE WHEN id % 2 = 0 THEN 'f' || id ELSE 'e' || id END AS title, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id DESC) AS n FROM mentions JOIN articles ON id = article_id)
SELECT company_id, string_agg('- ' || title, chr(10) ORDER BY n) AS titles FROM r WHERE n <= 5 GROUP BY company_id"""
)
def recent_titles(spark, sf_dir):
    k = F.col("id")
    articles = T.articles(spark, sf_dir).withColumns({"title_fr": F.when(k % 2 == 0, F.concat(F.lit("f"), k)).otherwise(""), "title_en": F.concat(F.lit("e"), k)})
    return R.recent_titles(T.mentions(spark, sf_dir), articles)


@query(
    """WITH p AS (SELECT page_id, page_id % 50 AS run_id, CASE WHEN page_id % 97 = 0 THEN ' ' ELSE 't' || page_id END AS title, CASE WHEN page_id % 83 = 0 THEN 'https://u@h/' ELSE url END AS url, CASE WHEN page_id % 101 > 0 THEN page_id::VARCHAR END AS external_id FROM pages),
t AS (SELECT page_id, run_id, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN NOT coalesce(length(url) <= 1000 AND regexp_full_match(url, '(?i:https?)://[^/?#@\\s\\\\]+([/?#][^\\s\\\\\\x00-\\x1f]*)?'), false) THEN 'url' END, CASE WHEN external_id IS NULL THEN 'external_id' END], lambda x: x IS NOT NULL), ',') AS failed FROM p)
SELECT page_id, failed, bool_and(failed = '') OVER (PARTITION BY run_id) AS run_valid FROM t"""
)
def validate_raw(spark, sf_dir):
    k = F.col("page_id")
    rows = T.read(spark, sf_dir, "pages").select(k, (k % 50).alias("run_id"), F.when(k % 97 == 0, " ").otherwise(F.concat(F.lit("t"), k)).alias("title"), F.when(k % 83 == 0, "https://u@h/").otherwise(F.col("url")).alias("url"), F.when(k % 101 > 0, k.cast("string")).alias("external_id"), F.lit(None).cast("string").alias("author"), F.lit("").alias("image_url"))
    return V.validate_raw(rows).select("page_id", F.array_join("failed_rules", ",").alias("failed"), "run_valid")


_STATUS = ("success", "partial", "failed", "no_change", "blocked")


@query(
    """WITH r AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'no_change' ELSE 'blocked' END AS status, user_id % 7 AS v, event_id % 3 AS rej, user_id % 4 AS w, event_id % 4 AS dup, event_id % 2 = 0 AS err FROM events),
t AS (SELECT *, v + rej + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS ext FROM r)
SELECT id, array_to_string(list_filter([CASE WHEN NOT (v + rej = ext AND dup + w <= v) THEN 'counts' END, CASE WHEN status IN ('failed', 'no_change', 'blocked') AND w > 0 THEN 'articles' END,
  CASE WHEN status IN ('success', 'partial') AND v <> w + dup THEN 'kept' END, CASE WHEN status = 'success' AND NOT (w > 0 AND NOT err AND rej = 0) THEN 'success' END, CASE WHEN status = 'partial' AND NOT (v > 0 AND (rej > 0 OR err)) THEN 'partial' END,
  CASE WHEN status = 'failed' AND NOT err THEN 'failed' END, CASE WHEN status = 'blocked' AND NOT err THEN 'blocked' END], lambda x: x IS NOT NULL), ',') AS failed FROM t"""
)
def validate_outcome(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (k % 5 + 1).cast("int"))
    rows = T.read(spark, sf_dir, "events").select(k.alias("id"), status.alias("status"), (u % 7).alias("valid"), (k % 3).alias("rejected"), (u % 4).alias("new"), F.lit(0).alias("updated"), (k % 4).alias("duplicate"), F.when(k % 2 == 0, F.array(F.lit("forbidden"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    rows = rows.withColumn("extracted", F.col("valid") + F.col("rejected") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).withColumn("discovered", F.col("extracted"))
    return rows.select("id", F.array_join(V.broken(V.counter_rules()), ",").alias("failed"))


@query(
    """WITH o AS (SELECT event_id AS id, CASE WHEN event_id % 13 > 0 THEN [200, 304, 403, 429, 500, 204][event_id % 6 + 1] END AS s, event_id % 7 > 0 AS has_url, event_id % 5 > 0 AS has_snap, event_id % 3 AS n,
  CASE WHEN event_id % 4 = 0 THEN 'forbidden' WHEN event_id % 4 = 1 THEN 'rate_limited' END AS e FROM events)
SELECT id, array_to_string(list_filter([CASE WHEN NOT ((s IS NULL OR has_url) AND (e IS NOT NULL OR coalesce(s BETWEEN 200 AND 299 OR s = 304, false))) THEN 'http_status' END,
  CASE WHEN e IS NOT NULL AND ((coalesce(s = 403, false) AND e <> 'forbidden') OR (coalesce(s = 429, false) AND e <> 'rate_limited')) THEN 'error' END,
  CASE WHEN e IS NULL AND NOT coalesce(s = 304, false) AND NOT has_snap THEN 'snapshot_id' END, CASE WHEN coalesce(s = 304, false) AND n > 0 THEN 'response_bytes' END], lambda x: x IS NOT NULL), ',') AS failed,
  CASE WHEN e = 'forbidden' THEN 'blocked' WHEN e = 'rate_limited' THEN 'retryable_error' WHEN s = 304 THEN 'not_modified' ELSE 'ok' END AS status FROM o"""
)
def validate_observation(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(k % 13 > 0, F.element_at(F.array(*map(F.lit, (200, 304, 403, 429, 500, 204))), (k % 6 + 1).cast("int")))
    rows = T.read(spark, sf_dir, "events").select(k.alias("id"), status.alias("http_status"), F.when(k % 7 > 0, "u").alias("final_url"), F.when(k % 5 > 0, "s").alias("snapshot_id"), (k % 3).alias("response_bytes"), F.when(k % 4 == 0, "forbidden").when(k % 4 == 1, "rate_limited").alias("error"))
    return rows.select("id", F.array_join(V.broken(V.observation_rules()), ",").alias("failed"), V.observation_status().alias("status"))


@query(
    """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'retry' WHEN 2 THEN 'blocked' WHEN 3 THEN 'blocked' ELSE 'extraction' END AS kind,
  CASE WHEN s IN (401, 403) THEN 'forbidden' WHEN s = 408 THEN 'timeout' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN s >= 400 THEN 'http_error' END AS code FROM (SELECT event_id, 200 + event_id % 400 AS s FROM events)"""
)
def classify_errors(spark, sf_dir):
    k = F.col("event_id")
    code = F.when(k % 5 == 1, "timeout").when(k % 5 == 2, "paywall").when(k % 5 == 3, "tls_error").when(k % 5 == 4, "missing_fields")
    return T.read(spark, sf_dir, "events").select(k.alias("id"), V.classify_error(code).alias("kind"), V.classify_http(200 + k % 400).alias("code"))


@query(
    """WITH i AS (SELECT user_id AS run_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'new' WHEN 'view' THEN 'duplicate' WHEN 'purchase' THEN 'updated' END AS o FROM events),
t AS (SELECT run_id, count(*) AS discovered, count(o) AS extracted, count(*) FILTER (o IN ('duplicate', 'new', 'updated')) AS valid, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'new') AS new, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'rejected') AS rejected FROM i GROUP BY run_id)
SELECT *, CASE WHEN duplicate = discovered THEN 'all_duplicates' END AS no_change_reason FROM t"""
)
def quality_report(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "rejected").when(kind == "click", "new").when(kind == "view", "duplicate").when(kind == "purchase", "updated")
    return V.quality_report(T.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), outcome.alias("outcome")))
