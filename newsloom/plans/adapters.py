"""The entity tables of the library, derived from the driver's tables, in Spark and as SQL.

Each function gives a DataFrame; ``SQL`` holds the same definition as a common table expression.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operators never read a clock; queries take this time.
AS_OF = datetime(2001, 8, 1)
RUNS_AS_OF = datetime(2024, 1, 30, 12)

#: Which tag an order's priority stands for.
TAGS = {"1-URGENT": "tech_breakthrough", "2-HIGH": "local_research", "3-MEDIUM": "investment"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source_id, published_at, processed, highlights, event_date``."""
    tag = F.col("o_orderpriority")
    first = F.coalesce(*[F.when(tag == k, F.lit(v)) for k, v in TAGS.items()], F.when(tag.startswith("4"), F.lit("local_event")))
    second = F.when(F.col("o_orderkey") % 7 == 0, F.lit("local_research"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 30).alias("source_id"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        (F.col("o_orderstatus") == "F").alias("processed"),
        F.array_compact(F.array(first, second)).alias("highlights"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int"))).alias("event_date"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_id, company_id, sentiment, mention_count, is_primary, score``; one row per pair."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("company_id"))
        .agg(F.min("l_returnflag").alias("flag"), F.count("*").alias("mention_count"), (F.min("l_linenumber") == 1).alias("is_primary"), F.max("l_discount").alias("score"))
        .withColumn("sentiment", F.when(F.col("company_id") % 11 != 0, F.when(F.col("flag") == "A", "positive").when(F.col("flag") == "N", "neutral").when(F.col("flag") == "R", "negative")))
        .drop("flag")
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, sector, is_map, review_status, entity_type``."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    joined = read(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("sector"),
        (k % 2 == 0).alias("is_map"),
        F.when(k % 10 == 9, "rejected").when(k % 10 == 8, "pending").otherwise("approved").alias("review_status"),
        F.when(k % 5 == 0, "school").when(k % 5 == 1, "support").otherwise("company").alias("entity_type"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, created_at, task_type, config_id, cost_usd, latency_ms, success``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("task_type"),
        (F.col("user_id") % 5).alias("config_id"),
        F.floor(F.col("value") * 100).cast("long").alias("cost_cents"),
        F.floor("value").cast("long").alias("latency_ms"),
        (k % 10 != 0).alias("success"),
    )


def crawl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source_id, started_at, ok, valid``."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("event_type") != "error").alias("ok"),
        F.floor("value").cast("long").alias("valid"),
    )


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, day, state, reserved, actual, usage_id`` in cents; every third is linked to a usage row."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reconciled").otherwise("reserved")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.to_date(F.lit("2024-01-01")).alias("first"),
        state.alias("state"),
        F.floor("o_totalprice").cast("long").alias("reserved"),
        F.floor(F.col("o_totalprice") / 2).cast("long").alias("actual"),
        F.when(k % 3 == 0, k).alias("usage_id"),
    ).withColumn("day", F.date_add("first", (F.col("id") % 30).cast("int"))).drop("first")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entity_id, created_at, finish``: errors end the entity's job, other events ask for one."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_type") == "error").alias("finish"))


SQL = {
    "articles": """articles AS (
  SELECT o_orderkey AS id, o_custkey % 30 AS source_id, o_orderdate AS published_at, o_orderstatus = 'F' AS processed,
    list_filter([CASE o_orderpriority WHEN '1-URGENT' THEN 'tech_breakthrough' WHEN '2-HIGH' THEN 'local_research' WHEN '3-MEDIUM' THEN 'investment'
      ELSE CASE WHEN o_orderpriority LIKE '4%' THEN 'local_event' END END, CASE WHEN o_orderkey % 7 = 0 THEN 'local_research' END], lambda x: x IS NOT NULL) AS highlights,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS event_date
  FROM orders)""",
    "mentions": """mentions AS (
  SELECT l_orderkey AS article_id, l_suppkey AS company_id,
    CASE WHEN l_suppkey % 11 <> 0 THEN CASE min(l_returnflag) WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'negative' END END AS sentiment,
    count(*) AS mention_count, min(l_linenumber) = 1 AS is_primary, max(l_discount) AS score
  FROM lineitem GROUP BY l_orderkey, l_suppkey)""",
    "companies": """companies AS (
  SELECT s_suppkey AS id, s_name AS name, r_name AS sector, s_suppkey % 2 = 0 AS is_map,
    CASE s_suppkey % 10 WHEN 9 THEN 'rejected' WHEN 8 THEN 'pending' ELSE 'approved' END AS review_status,
    CASE s_suppkey % 5 WHEN 0 THEN 'school' WHEN 1 THEN 'support' ELSE 'company' END AS entity_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "usage": """usage AS (
  SELECT event_id AS id, ts AS created_at, event_type AS task_type, user_id % 5 AS config_id, CAST(floor(value * 100) AS BIGINT) AS cost_cents,
    CAST(floor(value) AS BIGINT) AS latency_ms, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0 AS success
  FROM events)""",
    "crawl_runs": """crawl_runs AS (
  SELECT event_id AS id, user_id AS source_id, ts AS started_at, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS valid FROM events)""",
    "reservations": """reservations AS (
  SELECT o_orderkey AS id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day, CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'reconciled' ELSE 'reserved' END AS state,
    CAST(floor(o_totalprice) AS BIGINT) AS reserved, CAST(floor(o_totalprice / 2) AS BIGINT) AS actual, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS usage_id FROM orders)""",
    "job_events": """job_events AS (
  SELECT event_id AS id, user_id AS entity_id, ts AS created_at, event_type = 'error' AS finish FROM events)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
