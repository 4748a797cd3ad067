"""Usage reports, source health, failure streaks and baselines over append-only histories."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment


def usage_report(usage: DataFrame) -> DataFrame:
    """Calls, cost, failures and latency by day, by task, by config and in all, in one pass."""
    day = usage.withColumn("day", F.to_date("created_at").cast("string"))
    sets = [[F.col("day")], [F.col("task_type")], [F.col("config_id")], []]
    grouped = day.groupingSets(sets, F.col("day"), F.col("task_type"), F.col("config_id"))
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), F.sum("cost_cents").alias("cost_cents"), F.count_if(~F.col("success")).alias("failures"), F.sum("latency_ms").alias("latency_ms"))


def source_health(runs: DataFrame, sources: DataFrame, as_of: datetime) -> DataFrame:
    """Per source: stale if its last run is older than a day or missing, failing at three failures in twelve hours."""
    past = runs.where(F.col("started_at") <= moment(as_of))
    told = past.groupBy("source_id").agg(F.max("started_at").alias("last"), F.count_if(~F.col("ok") & (F.col("started_at") >= moment(as_of - timedelta(hours=12)))).alias("failures"))
    out = sources.join(told, "source_id", "left")
    return out.select("source_id", F.coalesce(F.col("last") < moment(as_of - timedelta(hours=24)), F.lit(True)).alias("is_stale"), F.coalesce("failures", F.lit(0)).alias("failures"), (F.coalesce("failures", F.lit(0)) >= 3).alias("is_failing"))


def failure_streak(runs: DataFrame) -> DataFrame:
    """Per run the number of failures in a row up to it; a success sets it back."""
    order = Window.partitionBy("source_id").orderBy("started_at", "id")
    island = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy("source_id", "island").orderBy("started_at", "id"))
    return island.withColumn("streak", streak).drop("island")


def previous_counts(runs: DataFrame, n: int = 30) -> DataFrame:
    """Per run how many runs of up to ``n`` came before it, and whether it falls below the baseline: under nine
    tenths of what it ``discovered``, or, with three runs before it, under half their median."""
    before = Window.partitionBy("source_id").orderBy("started_at", "id").rowsBetween(-n, -1)
    told = runs.withColumn("before", F.collect_list("valid").over(before))
    ordered = F.sort_array("before")
    k = F.size("before")
    middle = (F.get(ordered, F.floor((k - 1) / 2).cast("int")) + F.get(ordered, F.floor(k / 2).cast("int"))) / 2.0
    return told.withColumns({"n_before": k.cast("long"), "below_baseline": ((k >= 3) & F.coalesce(F.col("valid") < middle / 2, F.lit(False))) | ((F.col("discovered") > 0) & (F.col("valid") / F.col("discovered") < 0.9))}).drop("before")


def health_snapshot(usage: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """One row on the last day: runs, failures, calls, failed calls and their share as text."""
    since = moment(as_of - timedelta(hours=24))
    r = runs.where((F.col("started_at") >= since) & (F.col("started_at") <= moment(as_of))).agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed_runs"))
    u = usage.where((F.col("created_at") >= since) & (F.col("created_at") <= moment(as_of))).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed_calls"))
    return r.join(u, F.lit(True)).withColumn("failure_rate", F.format_string("%.1f%%", F.coalesce(100.0 * F.try_divide("failed_calls", "calls"), F.lit(0.0))))
