"""Captured pages, seeds and delivery logs as files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.times import moment

SEED = "slug string, name string, sector string, entity_type string, website string, company_stage string, spinoff_origin string, ai_analysis string"


def sound_pages(captures: DataFrame) -> DataFrame:
    """``captures`` whose ``body`` is what was captured: its SHA-256 is in ``snapshot_id``, its bytes are ``response_bytes``."""
    return captures.where((F.concat(F.lit("sha256:"), F.sha2("body", 256)) == F.col("snapshot_id")) & (F.octet_length("body") == F.col("response_bytes")))


def write_snapshots(pages: DataFrame, path: str) -> None:
    """``url, document_url, fetched_at, body`` with their ids and sizes, by day of capture; what is there is never overwritten."""
    told = pages.withColumns({"snapshot_id": F.concat(F.lit("sha256:"), F.sha2("body", 256)), "response_bytes": F.octet_length("body"), "capture_day": F.to_date("fetched_at")})
    told.write.mode("errorifexists").partitionBy("capture_day").parquet(path)


def scan_pages(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Sound pages of ``write_snapshots``; of one day only its folder is read."""
    rows = spark.read.parquet(path)
    return sound_pages(rows if day is None else rows.where(F.col("capture_day") == F.lit(day).cast("date"))).drop("capture_day")


def scan_seed(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON array; objects inside stay JSON text, unknown keys are left out, a broken file is an error."""
    return spark.read.schema(SEED).option("multiLine", True).option("mode", "FAILFAST").json(path)


def delivery_log(recipients: DataFrame, email_type: str, as_of: datetime) -> DataFrame:
    """``user_id, email_type, article_count, status, error_message, sent_at`` of ``user_id, n_articles, error``: sent unless there was an error, which has no count."""
    failed = F.col("error").isNotNull()
    return recipients.select("user_id", F.lit(email_type).alias("email_type"), F.when(~failed, F.col("n_articles")).alias("article_count"), F.when(failed, "failed").otherwise("sent").alias("status"), F.col("error").alias("error_message"), moment(as_of).alias("sent_at"))


def append_deliveries(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
