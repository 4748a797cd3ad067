"""Registered queries on ledgers, job histories, upserts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import ledgers as L
from newsloom.operators import merges as U
from newsloom.plans import adapters as T
from newsloom.plans.adapters import RUNS_AS_OF, with_tables
from newsloom.plans.registry import query


@query(with_tables("reservations") + " SELECT count(*) AS n_open, CAST(coalesce(sum(greatest(actual, reserved)), 0) AS BIGINT) AS exposure FROM reservations WHERE state NOT IN ('settled', 'reconciled')")
def unsettled_exposure(spark, sf_dir):
    return L.unsettled_exposure(T.reservations(spark, sf_dir))


@query(
    with_tables("reservations", "usage")
    + """, closed AS (SELECT day, sum(actual) AS closed FROM reservations WHERE state IN ('settled', 'reconciled') GROUP BY day),
loose AS (SELECT CAST(created_at AS DATE) AS day, CASE WHEN success THEN cost_cents END AS cost FROM usage WHERE id NOT IN (SELECT usage_id FROM reservations WHERE usage_id IS NOT NULL)),
logged AS (SELECT day, sum(cost) AS logged, count(*) FILTER (cost IS NULL) AS n_unpriced FROM loose GROUP BY day),
carried AS (SELECT coalesce(sum(reserved), 0) AS carried FROM reservations WHERE state = 'reserved')
SELECT day::VARCHAR AS day, CAST(coalesce(closed, 0) + coalesce(logged, 0) + carried AS BIGINT) AS spent, coalesce(n_unpriced, 0) AS n_unpriced FROM closed FULL JOIN logged USING (day), carried"""
)
def daily_spend(spark, sf_dir):
    usage = T.usage(spark, sf_dir).select("id", F.to_date("created_at").alias("day"), F.when(F.col("success"), F.col("cost_cents")).alias("cost"))
    return L.daily_spend(T.reservations(spark, sf_dir), usage).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH RECURSIVE asked AS (SELECT event_id AS id, user_id % 5 AS ledger, CAST(ts AS DATE)::VARCHAR AS day, CAST(floor(value * 100) AS BIGINT) AS amount,
  row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT ledger, day, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS admitted, CAST(0 AS BIGINT) AS held FROM (SELECT DISTINCT ledger, day FROM asked)
  UNION ALL
  SELECT a.ledger, a.day, a.n, a.id, s.held + a.amount <= 50000, CASE WHEN s.held + a.amount <= 50000 THEN s.held + a.amount ELSE s.held END
  FROM s JOIN asked a ON a.ledger = s.ledger AND a.day = s.day AND a.n = s.n + 1)
SELECT id, ledger, day, admitted, held FROM s WHERE n > 0"""
)
def admission_replay(spark, sf_dir):
    asked = T.usage(spark, sf_dir).select("id", F.col("config_id").alias("ledger"), F.to_date("created_at").cast("string").alias("day"), "created_at", F.coalesce("cost_cents", F.lit(0)).alias("amount"))
    return L.admission_replay(asked, 50_000).select("id", "ledger", "day", "admitted", "held")


_BREAKER = """WITH RECURSIVE calls AS (SELECT event_id AS id, user_id AS provider, epoch_us(ts) / 1e6::DOUBLE AS sec, event_type <> 'error' AS success,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT provider, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS INTEGER) AS failures, CAST(0 AS DOUBLE) AS opened, CAST(0 AS INTEGER) AS successes, CAST(0 AS DOUBLE) AS written, '' AS status
  FROM (SELECT DISTINCT provider FROM calls)
  UNION ALL
  SELECT provider, n, id, f2, CASE WHEN success THEN CASE WHEN keeps THEN o ELSE 0 END WHEN f2 >= 5 THEN sec ELSE o END, CASE WHEN success THEN CASE WHEN keeps THEN s1 + 1 ELSE 0 END WHEN f2 >= 5 THEN 0 ELSE s1 END, sec, status
  FROM (SELECT *, success AND f >= 5 AND s1 + 1 < 2 AS keeps, CASE WHEN NOT success THEN f + 1 WHEN f >= 5 AND s1 + 1 < 2 THEN f ELSE 0 END AS f2,
      CASE WHEN f < 5 THEN 'closed' WHEN sec - o > 300 THEN 'half_open' ELSE 'open' END AS status
    FROM (SELECT c.provider, c.n, c.id, c.sec, c.success, CASE WHEN c.sec - s.written > 3600 THEN 0 ELSE s.failures END AS f, CASE WHEN c.sec - s.written > 3600 THEN 0 ELSE s.opened END AS o,
        CASE WHEN c.sec - s.written > 3600 THEN 0 ELSE s.successes END AS s1 FROM s JOIN calls c ON c.provider = s.provider AND c.n = s.n + 1)))
SELECT id, provider, status, failures AS n_failures FROM s WHERE n > 0"""


@query(_BREAKER)
def failure_breaker(spark, sf_dir):
    calls = T.crawl_runs(spark, sf_dir).select("id", F.col("source_id").alias("provider"), F.col("started_at").alias("created_at"), F.col("ok").alias("success"))
    return L.failure_breaker(calls).select("id", "provider", "status", "n_failures")


@query("SELECT l_orderkey, count(*) AS n, CASE WHEN min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) THEN 'tracked' ELSE 'incomplete' END AS state FROM lineitem GROUP BY l_orderkey")
def sequence_check(spark, sf_dir):
    return L.sequence_check(T.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    with_tables("job_events")
    + """, spans AS (SELECT *, coalesce(sum(finish::INT) OVER (PARTITION BY entity_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM job_events),
served AS (SELECT id, entity_id, first_value(id) OVER (PARTITION BY entity_id, span ORDER BY created_at, id) AS job_id FROM spans WHERE NOT finish)
SELECT id, entity_id, job_id, id <> job_id AS absorbed FROM served"""
)
def coalesced_jobs(spark, sf_dir):
    return L.coalesced_jobs(T.job_events(spark, sf_dir))


@query(
    """SELECT user_id AS job_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-29 12:00:00' THEN 'expired'
  WHEN event_type <> 'click' AND ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-30 12:00:00' THEN 'failed' WHEN event_type = 'click' THEN 'queued' ELSE 'running' END AS state
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def job_state(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    state = F.when(F.col("event_type") == "click", "queued").otherwise("running")
    return L.job_state(T.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), at.alias("created_at"), state.alias("state"), (at + F.expr("interval 1 hour")).alias("deadline")), RUNS_AS_OF)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return L.latest_per_key(T.read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """SELECT event_id, CAST(sum(changed::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation
FROM (SELECT *, row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
)
def generation_bump(spark, sf_dir):
    return L.generation_bump(T.read(spark, sf_dir, "events"), "user_id", ["event_type"], "ts", "event_id").select("event_id", "generation")


@query(
    """WITH runs AS (SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finished_at FROM events),
articles AS (SELECT event_id AS article_id, user_id AS source_id, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS crawled_at FROM events)
SELECT run_id, article_id FROM runs JOIN articles USING (source_id) WHERE crawled_at >= started_at AND (finished_at IS NULL OR crawled_at <= finished_at)"""
)
def run_articles(spark, sf_dir):
    from pyspark.sql import Window

    rows = T.read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    runs = rows.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), at.alias("started_at")).withColumn("finished_at", F.lead("started_at").over(Window.partitionBy("source_id").orderBy("started_at", "run_id")))
    articles = rows.select(F.col("event_id").alias("article_id"), F.col("user_id").alias("source_id"), (at + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("crawled_at"))
    return L.run_articles(runs, articles)


@query(
    """WITH cut AS (SELECT conv_id, turn, substring(text, 1, 200) AS part FROM conversations),
roomy AS (SELECT *, 600 - coalesce(sum(length(part)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM cut)
SELECT conv_id AS session_id, turn AS position, substring(part, 1, CAST(room AS INTEGER)) AS part FROM roomy WHERE room > 0"""
)
def prompt_pack(spark, sf_dir):
    return L.prompt_pack(T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "text"), 200, 600)


@query(
    with_tables("crawl_runs")
    + """, told AS (SELECT id, started_at AS t, started_at + to_seconds(valid) AS e, CASE WHEN ok THEN 'ok' WHEN source_id % 2 = 0 THEN 'retry' ELSE 'blocked' END AS kind, id % 8 AS streak,
    CASE WHEN id % 5 = 0 THEN id % 200000 END AS asked, t + INTERVAL 30 MINUTE AS late FROM crawl_runs),
-- Paris is an hour ahead of UTC all January, so its one o'clock is midnight
anchored AS (SELECT *, CASE WHEN date_trunc('day', late) > late THEN date_trunc('day', late) ELSE date_trunc('day', late) + INTERVAL 1 DAY END AS anchor FROM told)
SELECT id, CAST(CASE WHEN kind = 'blocked' THEN e + INTERVAL 24 HOUR WHEN kind = 'retry' AND asked > 0 THEN e + to_seconds(least(asked, 86400))
  WHEN kind = 'retry' THEN e + to_minutes(CAST(least(360, 15 * pow(2, greatest(streak - 1, 0))) AS BIGINT)) ELSE least(t + INTERVAL 360 MINUTE, anchor) END AS TIMESTAMP) AS due FROM anchored"""
)
def next_due(spark, sf_dir):
    kind = F.when(F.col("ok"), "ok").when(F.col("source_id") % 2 == 0, "retry").otherwise("blocked")
    finished = F.col("started_at") + F.make_dt_interval(secs=F.col("valid"))
    asked = F.when(F.col("id") % 5 == 0, F.col("id") % 200000)
    due = L.next_due(F.col("started_at"), finished, kind, F.col("id") % 8, F.lit(360), asked)
    return T.crawl_runs(spark, sf_dir).select("id", due.alias("due"))


@query(
    """WITH p AS (SELECT page_id, page_id % 10 AS source_id, length(html) AS n, url FROM pages),
stored AS (SELECT page_id AS id, source_id, 'x' || page_id AS external_id, url, CASE WHEN n % 3 = 0 THEN 2 WHEN n % 3 = 1 THEN 1 ELSE 0 END AS old FROM p WHERE page_id % 2 = 0),
incoming AS (SELECT source_id, CASE WHEN page_id % 7 = 0 THEN 'y' ELSE 'x' END || page_id AS external_id, CASE WHEN page_id % 11 = 0 THEN url || '#moved' ELSE url END AS url, CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END AS level FROM p),
u AS (SELECT source_id, url, min(id) AS uid FROM stored GROUP BY ALL),
hit AS (SELECT i.*, coalesce(e.id, u.uid) AS stored_id FROM incoming i LEFT JOIN stored e USING (source_id, external_id) LEFT JOIN u ON u.source_id = i.source_id AND u.url = i.url),
told AS (SELECT h.source_id, h.external_id, h.url, stored_id, CASE WHEN stored_id IS NULL THEN 'new' WHEN level <= old THEN 'duplicate' WHEN s.url <> h.url THEN 'conflict' ELSE 'updated' END AS action FROM hit h LEFT JOIN stored s ON s.id = stored_id)
SELECT *, bool_or(action = 'conflict') OVER (PARTITION BY source_id) AS source_failed FROM told"""
)
def upsert_articles(spark, sf_dir):
    k, n = F.col("page_id"), F.length("html")
    rows = T.read(spark, sf_dir, "pages").select("page_id", (k % 10).alias("source_id"), "url", n.alias("n"), F.lit("body").alias("content"))
    level = F.when(F.col("n") % 3 == 0, "full").when(F.col("n") % 3 == 1, "excerpt").otherwise("metadata_only")
    stored = rows.where(k % 2 == 0).select(k.alias("id"), "source_id", F.concat(F.lit("x"), k).alias("external_id"), "url", level.alias("content_level"), "content")
    incoming = rows.select(
        "source_id",
        F.concat(F.when(k % 7 == 0, "y").otherwise("x"), k).alias("external_id"),
        F.when(k % 11 == 0, F.concat("url", F.lit("#moved"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("n") % 2 == 0, "full").otherwise("metadata_only").alias("content_level"),
        "content",
    )
    return U.upsert_articles(stored, incoming)


@query(
    with_tables("mentions")
    + """, t AS (SELECT * FROM mentions WHERE company_id % 4 <> 1), d AS (SELECT article_id, company_id - 1 AS company_id, sentiment, mention_count, is_primary, score FROM mentions WHERE company_id % 4 = 1)
SELECT article_id, company_id, greatest(t.mention_count, d.mention_count) AS mention_count, coalesce(t.is_primary, false) OR coalesce(d.is_primary, false) AS is_primary,
  CASE WHEN t.article_id IS NULL THEN d.sentiment WHEN coalesce(t.sentiment, 'neutral') = 'neutral' AND coalesce(d.sentiment, 'neutral') <> 'neutral' THEN d.sentiment ELSE t.sentiment END AS sentiment,
  CASE WHEN t.article_id IS NULL THEN d.score WHEN coalesce(t.sentiment, 'neutral') = 'neutral' AND coalesce(d.sentiment, 'neutral') <> 'neutral' THEN d.score ELSE t.score END AS score
FROM t FULL JOIN d USING (article_id, company_id)"""
)
def merge_companies(spark, sf_dir):
    k = F.col("s_suppkey")
    pairs = T.read(spark, sf_dir, "supplier").where(k % 4 == 1).select((k - 1).alias("target_id"), k.alias("duplicate_id"))
    return U.merge_links(T.mentions(spark, sf_dir), pairs)


@query(
    """WITH c AS (SELECT p_partkey, p_name AS n0, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS n1, p_size::VARCHAR AS s0, (p_size + p_partkey % 2)::VARCHAR AS s1 FROM part)
SELECT p_partkey, 'p_name' AS field, n0 AS before, n1 AS after FROM c WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT p_partkey, 'p_size', s0, s1 FROM c WHERE s0 IS DISTINCT FROM s1"""
)
def field_changes(spark, sf_dir):
    old = T.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = old.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), (F.col("p_size") + F.col("p_partkey") % 2).alias("p_size"))
    return U.field_changes(old, new, "p_partkey", ["p_name", "p_size"])


@query("SELECT coalesce(s_suppkey, l_suppkey) AS id, CASE WHEN s_suppkey IS NULL THEN 'extra' WHEN l_suppkey IS NULL THEN 'missing' ELSE 'equal' END AS verdict FROM supplier FULL JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02) ON s_suppkey = l_suppkey")
def coverage_diff(spark, sf_dir):
    found = T.read(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_discount < 0.02").select(F.col("l_suppkey").alias("id"))
    return U.coverage_diff(T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), found, ["id"])


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS auto, list_filter(regexp_extract_all(lower(p_name || ' ' || (p_partkey % 5)), '[a-z0-9]+'), lambda w: w NOT IN ('group', 'groupe')) AS w FROM part WHERE p_partkey % 10 <> 9),
k AS (SELECT id, auto, array_to_string(w, '') AS a, array_to_string(list_sort(w), ' ') AS b FROM c WHERE length(array_to_string(w, '')) >= 4),
e AS (SELECT DISTINCT a AS x, b AS y FROM k UNION SELECT DISTINCT b, a FROM k), r AS (SELECT x, x AS root FROM e UNION SELECT e.x, r.root FROM r JOIN e ON e.y = r.x),
m AS (SELECT x, min(root) AS root FROM r GROUP BY x), g AS (SELECT id, auto, root FROM k JOIN m ON a = x)
SELECT id, first_value(id) OVER (PARTITION BY root ORDER BY auto, id) AS keeper_id, count(*) OVER (PARTITION BY root) AS group_size FROM g QUALIFY count(*) OVER (PARTITION BY root) > 1"""
)
def duplicate_companies(spark, sf_dir):
    k = F.col("p_partkey")
    return U.duplicate_companies(T.read(spark, sf_dir, "part").select(k.alias("id"), (k % 3 == 0).alias("is_auto_created"), F.concat_ws(" ", "p_name", (k % 5).cast("string")).alias("name"), F.when(k % 10 == 9, "rejected").otherwise("approved").alias("review_status")))
