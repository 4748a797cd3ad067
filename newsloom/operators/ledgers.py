"""Spending, job and version histories, each told from its rows alone."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment
from newsloom.operators.ordered import fold_in_order

#: States in which the actual amount is known.
CLOSED = ("settled", "reconciled")
#: Fixed values of the failure breaker: failures that open it, seconds until a trial, successes that close it, seconds after which a count lapses.
BREAKER = {"failures": 5, "rest": 300, "successes": 2, "lapse": 3600}


def quote_usd(input_price: Column, input_limit: Column, output_price: Column, output_limit: Column) -> Column:
    """The most that a call can cost, rounded up to six places; null if a term is missing or negative."""
    cost = (input_price * input_limit + output_price * output_limit) / 1000
    fit = (input_price >= 0) & (output_price >= 0) & (input_limit >= 0) & (output_limit >= 0)
    return F.when(fit, F.ceil(cost, 6))


def unsettled_exposure(reservations: DataFrame) -> DataFrame:
    """Open reservations: their number, and the sum of the larger of actual and reserved."""
    return reservations.where(~F.col("state").isin(*CLOSED)).agg(F.count("*").alias("n_open"), F.coalesce(F.sum(F.greatest("actual", "reserved")), F.lit(0)).alias("exposure"))


def daily_spend(reservations: DataFrame, usage: DataFrame) -> DataFrame:
    """Per UTC day the money committed: closed reservations at their actual amount, open ones of any
    day in full, and usage that no reservation is linked to; with the number of such unpriced usage rows."""
    done = F.col("state").isin(*CLOSED)
    closed = reservations.where(done).groupBy("day").agg(F.sum("actual").alias("closed"))
    loose = usage.join(reservations.select(F.col("usage_id").alias("id")), "id", "left_anti")
    logged = loose.groupBy("day").agg(F.sum("cost").alias("logged"), F.count_if(F.col("cost").isNull()).alias("n_unpriced"))
    carried = reservations.where(~done).agg(F.coalesce(F.sum("reserved"), F.lit(0)).alias("carried"))  # one row
    none = F.lit(0)
    total = F.coalesce("closed", none) + F.coalesce("logged", none) + F.col("carried")
    joined = closed.join(logged, "day", "full_outer").join(F.broadcast(carried), F.lit(True))
    return joined.select("day", total.alias("spent"), F.coalesce("n_unpriced", none).alias("n_unpriced"))


def admission_replay(requests: DataFrame, limit: int) -> DataFrame:
    """Per ledger and day, in order: admit a request if what is held plus it stays within ``limit`` (0: none)."""

    def step(held, row):
        fits = limit == 0 or held + row[0] <= limit
        held += row[0] if fits else 0
        return held, (bool(fits), int(held))

    return fold_in_order(requests, ["ledger", "day"], ["created_at", "id"], int, step, ["amount"], "admitted boolean, held long")


def breaker_start() -> tuple:
    return 0, 0.0, 0, 0.0


def breaker_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """``state``: failures, time of opening, successes since, time of the last write. ``row``: time in seconds, success."""
    failures, opened, successes, written = state
    now, success = row
    if success is None or success != success:  # a call without an outcome changes nothing
        is_open = failures >= BREAKER["failures"] and now - written <= BREAKER["lapse"]
        return state, ("closed" if not is_open else "half_open" if now - opened > BREAKER["rest"] else "open", failures)
    if now - written > BREAKER["lapse"]:
        failures, opened, successes = 0, 0.0, 0
    is_open = failures >= BREAKER["failures"]
    before = "closed" if not is_open else "half_open" if now - opened > BREAKER["rest"] else "open"
    if not success:
        failures += 1
        if failures >= BREAKER["failures"]:
            opened, successes = now, 0
    elif is_open and successes + 1 < BREAKER["successes"]:
        successes += 1
    else:
        failures, opened, successes = 0, 0.0, 0
    return (failures, opened, successes, now), (before, failures)


def failure_breaker(calls: DataFrame) -> DataFrame:
    """Per call the status that the provider's breaker had before it and the failures counted after it."""
    timed = calls.withColumn("at", F.unix_micros("created_at") / 1e6)
    return fold_in_order(timed, ["provider"], ["created_at", "id"], breaker_start, breaker_step, ["at", "success"], "status string, n_failures int").drop("at")


def sequence_check(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Per key whether its numbers are 1 to n without a gap or a repeat."""
    told = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("n_distinct"))
    whole = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("n_distinct") == F.col("n"))
    return told.select(key, "n", F.when(whole, "tracked").otherwise("incomplete").alias("state"))


def coalesced_jobs(events: DataFrame) -> DataFrame:
    """Requests with the job that serves them: the first since the entity's last finish starts one, later ones join it."""
    order = Window.partitionBy("entity_id").orderBy("created_at", "id")
    span = events.withColumn("span", F.coalesce(F.sum(F.col("finish").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = span.where(~F.col("finish"))
    first = F.first("id").over(Window.partitionBy("entity_id", "span").orderBy("created_at", "id"))
    return asked.select("id", "entity_id", first.alias("job_id")).withColumn("absorbed", F.col("id") != F.col("job_id"))


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in ``order``: an aggregate with map-side combine, no window."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def job_state(events: DataFrame, as_of: datetime) -> DataFrame:
    """Current state of each job from its last event: queued for over a day has expired, running past its deadline has failed."""
    last = latest_per_key(events, ["job_id"], "created_at", "id")
    late = moment(as_of)
    expired = (F.col("state") == "queued") & (F.col("created_at") < moment(as_of - timedelta(hours=24)))
    broken = (F.col("state") == "running") & (F.col("deadline") < late)
    return last.select("job_id", F.when(expired, "expired").when(broken, "failed").otherwise(F.col("state")).alias("state"))


def generation_bump(snapshots: DataFrame, key: str, watched: list[str], *order: str) -> DataFrame:
    """Per snapshot the version of its key: it rises when a watched column differs from the snapshot before."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*watched)
    changed = F.row_number().over(w).eqNullSafe(1) | ~F.lag(now).over(w).eqNullSafe(now)
    return snapshots.withColumn("changed", changed.cast("int")).withColumn("generation", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def run_articles(runs: DataFrame, articles: DataFrame, slice_seconds: int = 86400) -> DataFrame:
    """Articles crawled while a run of their source went on; a run without an end is still going on.

    Closed runs meet articles on source and time slice, so a source with many runs does not meet all
    its articles; an open one (at most the newest of a source counts) meets them on the source.
    """
    at = lambda c: F.floor(F.unix_seconds(c) / slice_seconds)
    closed = runs.where("finished_at is not null").withColumn("slice", F.explode(F.sequence(at("started_at"), at("finished_at"))))
    sliced = articles.withColumn("slice", at("crawled_at"))
    within = closed.join(sliced, ["source_id", "slice"]).where("crawled_at between started_at and finished_at")
    going = latest_per_key(runs.where("finished_at is null").select("source_id", "run_id", "started_at"), ["source_id"], "started_at", "run_id")
    after = going.join(articles, "source_id").where("crawled_at >= started_at")
    return within.select("run_id", "article_id").unionByName(after.select("run_id", "article_id"))


def prompt_pack(pages: DataFrame, each: int = 4000, total: int = 12000) -> DataFrame:
    """Per session its pages in order, at most ``each`` characters of a page and ``total`` of all."""
    before = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    cut = pages.withColumn("part", F.substring("text", 1, each))
    room = F.lit(total) - F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))
    return cut.withColumn("room", room).where("room > 0").select("session_id", "position", F.expr("substring(part, 1, cast(room as int))").alias("part"))


def next_due(started: Column, finished: Column, kind: Column, streak: Column, period_minutes: Column, retry_after: Column | None = None, hour: int = 1, zone: str = "Europe/Paris") -> Column:
    """When a source is due again; the period is a quarter of an hour at least.

    After success or a failed extraction: the period from the start, but no later than the first local
    ``hour`` that is more than half an hour after the start. Retries count from the end: as the server
    asked (a day at most), else a quarter of an hour, doubled for each failure before this one, up to
    the period. Blocked sources rest for a day. An hour that the clock skips is the first instant after
    the gap, one that it repeats the first of the two.
    """
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    period = F.greatest(F.coalesce(period_minutes, F.lit(0)), F.lit(15))
    late = started + F.expr("interval 30 minutes")
    day = F.date_trunc("day", F.from_utc_timestamp(late, zone))
    at = lambda n: F.to_utc_timestamp(day + F.expr(f"interval {24 * n + hour} hours"), zone)
    anchor = F.when(at(0) > late, at(0)).when(at(1) > late, at(1)).otherwise(at(2))
    again = F.least(period, F.lit(15) * F.pow(F.lit(2), F.least(F.greatest(streak - 1, F.lit(0)), F.lit(16))))
    asked = F.lit(None).cast("int") if retry_after is None else F.when(retry_after > 0, F.least(retry_after, F.lit(86400)))
    retry = F.coalesce(finished + F.make_dt_interval(secs=asked), finished + minutes(again))
    return F.when(kind == "blocked", finished + F.expr("interval 24 hours")).when(kind == "retry", retry).otherwise(F.least(started + minutes(period), anchor))
