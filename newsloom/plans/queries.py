"""The registered queries of the library's own operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import articles as A
from newsloom.operators import companies as C
from newsloom.operators import monitoring as M
from newsloom.plans import adapters as T
from newsloom.plans import audit_queries, entity_queries, extraction_queries, history_queries, page_queries, reader_queries, source_queries  # noqa: F401 - they register their queries
from newsloom.plans.adapters import AS_OF, RUNS_AS_OF, with_tables
from newsloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from newsloom.streaming.usage import usage_windows

_SCORE = "coalesce(list_max(list_transform(highlights, lambda t: CASE t WHEN 'tech_breakthrough' THEN 4 WHEN 'local_research' THEN 3 WHEN 'investment' THEN 2 WHEN 'local_event' THEN 1 ELSE 0 END)), 0)"
_FEED = f"""feed AS (
  SELECT id, published_at, {_SCORE} AS score FROM articles
  WHERE (list_has_any(highlights, ['tech_breakthrough', 'local_research', 'investment']) AND published_at BETWEEN TIMESTAMP '2001-07-02' AND TIMESTAMP '2001-08-01')
    OR (list_contains(highlights, 'local_event') AND coalesce(event_date >= DATE '2001-08-01' OR (event_date IS NULL AND published_at >= TIMESTAMP '2001-07-25'), false)))"""


@query(with_tables("articles") + " SELECT id, source_id FROM articles WHERE list_contains(highlights, 'local_research') AND published_at >= TIMESTAMP '1998-03-01' AND published_at < TIMESTAMP '1998-07-01' AND source_id = 7")
def search_articles(spark, sf_dir):
    return A.search_articles(T.articles(spark, sf_dir), 7, "local_research", "1998-03-01", "1998-06-30").select("id", "source_id")


@query(with_tables("articles") + " SELECT CAST(published_at AS DATE)::VARCHAR AS day, count(*) AS n FROM articles WHERE published_at >= TIMESTAMP '1999-01-01' AND published_at < TIMESTAMP '2000-01-01' GROUP BY 1")
def day_range(spark, sf_dir):
    rows = T.articles(spark, sf_dir).where(A.day_range(F.col("published_at"), "1999-01-01", "1999-12-31"))
    return rows.groupBy(F.to_date("published_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(text)), 'tion the')")
def search_text(spark, sf_dir):
    return A.search_text(T.read(spark, sf_dir, "documents"), "Tion the", ["text"]).select("doc_id", "lang")


@query(with_tables("companies") + " SELECT id, name, sector FROM companies WHERE review_status <> 'rejected' AND is_map AND (contains(lower(name), 'a') OR contains(lower(sector), 'a'))")
def search_companies(spark, sf_dir):
    return C.search_companies(T.companies(spark, sf_dir), "A", map_only=True).select("id", "name", "sector")


@query(with_tables("articles") + f" SELECT id, {_SCORE} AS score FROM articles")
def highlight_score(spark, sf_dir):
    return T.articles(spark, sf_dir).select("id", A.highlight_score(F.col("highlights")).alias("score"))


@query(with_tables("articles") + ", " + _FEED + " SELECT id, score FROM feed")
def highlight_feed(spark, sf_dir):
    return A.highlight_feed(T.articles(spark, sf_dir), AS_OF).select("id", "score")


@query(with_tables("articles") + ", " + _FEED + " SELECT id, score FROM feed ORDER BY score DESC, published_at DESC, id DESC LIMIT 5 OFFSET 5")
def highlight_page(spark, sf_dir):
    feed = A.highlight_feed(T.articles(spark, sf_dir), AS_OF)
    return A.paginate(feed, [F.desc("score"), F.desc("published_at"), F.desc("id")], 2, 5).select("id", "score")


@query(with_tables("articles") + f" SELECT id, {_SCORE} AS score FROM articles WHERE published_at >= TIMESTAMP '2001-07-29' AND {_SCORE} > 0 ORDER BY score DESC, published_at DESC, id DESC LIMIT 15")
def top_insights(spark, sf_dir):
    return A.top_insights(T.articles(spark, sf_dir), AS_OF).select("id", "score")


@query(with_tables("articles", "mentions") + " SELECT company_id, article_id, rank FROM (SELECT company_id, article_id, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, article_id DESC) AS rank FROM mentions JOIN articles ON id = article_id) WHERE rank <= 10")
def company_articles(spark, sf_dir):
    dated = T.mentions(spark, sf_dir).join(T.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return A.newest_per_key(dated, "company_id", 10, F.desc("published_at"), F.desc("article_id")).select("company_id", "article_id", "rank")


@query(with_tables("articles") + " SELECT id FROM articles WHERE NOT processed AND id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def unprocessed_without_job(spark, sf_dir):
    jobs = T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_id"))
    return A.unprocessed_without_job(T.articles(spark, sf_dir), jobs).select("id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_batch(spark, sf_dir):
    rows = T.read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("external_id"))
    return A.dedup_batch(rows, ["source", "external_id"], [F.col("doc_id")]).select("doc_id")


@query(with_tables("companies", "mentions") + " SELECT id, name, sector, entity_type, count(article_id) AS n_articles FROM companies LEFT JOIN mentions ON id = company_id WHERE is_map AND review_status = 'approved' GROUP BY ALL")
def company_article_counts(spark, sf_dir):
    return C.article_counts(T.companies(spark, sf_dir), T.mentions(spark, sf_dir))


@query(with_tables("mentions") + " SELECT company_id, count(*) FILTER (sentiment = 'positive') AS n_positive, count(*) FILTER (sentiment = 'neutral') AS n_neutral, count(*) FILTER (sentiment = 'negative') AS n_negative FROM mentions GROUP BY company_id")
def sentiment_counts(spark, sf_dir):
    return C.sentiment_counts(T.mentions(spark, sf_dir))


@query(
    with_tables("articles", "mentions")
    + """, weeks AS (SELECT company_id, CAST(date_trunc('week', published_at) AS DATE)::VARCHAR AS week, count(*) FILTER (sentiment = 'positive') AS n_positive,
  count(*) FILTER (sentiment = 'neutral') AS n_neutral, count(*) FILTER (sentiment = 'negative') AS n_negative FROM mentions JOIN articles ON id = article_id GROUP BY 1, 2)
SELECT * FROM weeks QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY week DESC) <= 12"""
)
def sentiment_trend(spark, sf_dir):
    return C.sentiment_trend(T.mentions(spark, sf_dir), T.articles(spark, sf_dir)).withColumn("week", F.col("week").cast("string"))


@query(
    with_tables("companies", "mentions")
    + """, counted AS (SELECT id, name, sector, entity_type, count(article_id) AS n FROM companies LEFT JOIN mentions ON id = company_id WHERE is_map AND review_status = 'approved' GROUP BY ALL)
SELECT CASE entity_type WHEN 'school' THEN 'Schools' WHEN 'support' THEN 'Support' ELSE coalesce(sector, 'Uncategorized') END AS "group", count(*) AS n_companies,
  CAST(sum(n) AS BIGINT) AS n_articles, string_agg(name, ',' ORDER BY name, id) AS names FROM counted GROUP BY 1"""
)
def ecosystem_map(spark, sf_dir):
    return C.ecosystem_map(C.article_counts(T.companies(spark, sf_dir), T.mentions(spark, sf_dir)))


@query(with_tables("companies") + " SELECT DISTINCT sector FROM companies WHERE sector IS NOT NULL")
def distinct_sectors(spark, sf_dir):
    return T.companies(spark, sf_dir).where("sector is not null").select("sector").distinct()


@query(
    with_tables("usage")
    + """ SELECT CAST(created_at AS DATE)::VARCHAR AS day, task_type, config_id, CAST(grouping(day, task_type, config_id) AS BIGINT) AS level, count(*) AS calls,
  CAST(sum(cost_cents) AS BIGINT) AS cost_cents, count(*) FILTER (NOT success) AS failures, CAST(sum(latency_ms) AS BIGINT) AS latency_ms
FROM usage GROUP BY GROUPING SETS ((day), (task_type), (config_id), ())"""
)
def usage_report(spark, sf_dir):
    return M.usage_report(T.usage(spark, sf_dir))


@query(
    with_tables("crawl_runs")
    + """, told AS (SELECT source_id, max(started_at) AS last, count(*) FILTER (NOT ok AND started_at >= TIMESTAMP '2024-01-30 00:00:00') AS failures FROM crawl_runs
  WHERE started_at <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY source_id), sources AS (SELECT DISTINCT source_id FROM crawl_runs)
SELECT source_id, coalesce(last < TIMESTAMP '2024-01-29 12:00:00', true) AS is_stale, coalesce(failures, 0) AS failures, coalesce(failures, 0) >= 3 AS is_failing FROM sources LEFT JOIN told USING (source_id)"""
)
def source_health(spark, sf_dir):
    runs = T.crawl_runs(spark, sf_dir)
    return M.source_health(runs, runs.select("source_id").distinct(), RUNS_AS_OF)


@query(
    with_tables("crawl_runs")
    + """, islands AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS island FROM crawl_runs)
SELECT id, source_id, CAST(sum((NOT ok)::INT) OVER (PARTITION BY source_id, island ORDER BY started_at, id) AS BIGINT) AS streak FROM islands"""
)
def failure_streak(spark, sf_dir):
    return M.failure_streak(T.crawl_runs(spark, sf_dir)).select("id", "source_id", "streak")


@query(
    with_tables("crawl_runs")
    + """ SELECT id, count(*) OVER w AS n_before, (count(*) OVER w >= 3 AND valid < median(valid) OVER w / 2) OR (valid + id % 9 > 0 AND valid / (valid + id % 9)::DOUBLE < 0.9) AS below_baseline
FROM crawl_runs WINDOW w AS (PARTITION BY source_id ORDER BY started_at, id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""
)
def below_baseline(spark, sf_dir):
    return M.previous_counts(T.crawl_runs(spark, sf_dir).withColumn("discovered", F.col("valid") + F.col("id") % 9)).select("id", "n_before", "below_baseline")


@query(
    with_tables("crawl_runs", "usage")
    + """, r AS (SELECT count(*) AS runs, count(*) FILTER (NOT ok) AS failed_runs FROM crawl_runs WHERE started_at BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'),
u AS (SELECT count(*) AS calls, count(*) FILTER (NOT success) AS failed_calls FROM usage WHERE created_at BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00')
SELECT runs, failed_runs, calls, failed_calls, printf('%.1f%%', coalesce(100.0::DOUBLE * failed_calls / nullif(calls, 0), 0)) AS failure_rate FROM r, u"""
)
def health_snapshot(spark, sf_dir):
    return M.health_snapshot(T.usage(spark, sf_dir), T.crawl_runs(spark, sf_dir), RUNS_AS_OF)


@query(with_tables("usage") + " SELECT CAST(date_trunc('day', created_at) AS DATE)::VARCHAR AS day, task_type, count(*) AS calls, count(*) FILTER (NOT success) AS failures FROM usage GROUP BY 1, 2")
def usage_by_window(spark, sf_dir):
    return usage_windows(T.usage(spark, sf_dir)).select(F.to_date("start").cast("string").alias("day"), "task_type", "calls", "failures")


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')) AS text FROM documents")
def collapse_space(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.collapse_space(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN regexp_replace(substring(text, 1, 160), ' [^ ]*$', '') || '...' ELSE text END AS excerpt FROM documents")
def truncate_words(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.truncate_words(F.col("text"), 160).alias("excerpt"))


@query("SELECT page_id, substring(sha256(url), 1, 32) AS external_id, regexp_replace(url, '[?#].*$', '') AS redacted FROM pages")
def url_identity(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", X.url_identity(F.col("url")).alias("external_id"), X.redact_url(F.col("url")).alias("redacted"))


@query(
    """SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'metadata_only' WHEN length(c) >= 200 AND len(string_split(c, chr(10) || chr(10))) >= 2 THEN 'full' ELSE 'excerpt' END AS level
FROM (SELECT doc_id, text, replace(text, chr(10), chr(10) || chr(10)) AS c FROM documents)"""
)
def content_level(spark, sf_dir):
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return T.read(spark, sf_dir, "documents").select("doc_id", X.content_level(body).alias("level"))
