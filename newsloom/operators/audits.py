"""States told from histories, and checks of what was recorded."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment
from newsloom.operators.ledgers import latest_per_key, next_due


def source_state(runs: DataFrame, period_minutes: int, zone: str = "Europe/Paris", attention_after: int = 3) -> DataFrame:
    """``source_id, streak, attention_reason, attention_since, next_due_at, last_success_at`` from the run log.

    ``runs``: ``id, source_id, started_at, finished_at, kind`` (ok, retry, blocked, extraction),
    ``error_code``. A blocked run asks for attention at once, an extraction failure from the third failure
    in a row; the reason stays through other failures, a success ends it, and its time is that of the
    first run with that reason since.
    """
    order = Window.partitionBy("source_id").orderBy("started_at", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("island", F.sum((F.col("kind") == "ok").cast("int")).over(so_far))
    own = Window.partitionBy("source_id", "island").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum((F.col("kind") != "ok").cast("long")).over(own))
    reason = F.when(F.col("kind") == "blocked", F.col("error_code")).when((F.col("kind") == "extraction") & (F.col("streak") >= attention_after), "extraction_failed")
    rows = rows.withColumn("reason", reason).withColumn("held", F.last("reason", ignorenulls=True).over(own))
    before = Window.partitionBy("source_id", "island").orderBy("started_at", "id")
    rows = rows.withColumn("fresh", F.col("held").isNotNull() & ~F.col("held").eqNullSafe(F.lag("held").over(before)))
    rows = rows.withColumn("since", F.last(F.when(F.col("fresh"), F.col("finished_at")), ignorenulls=True).over(own))
    rows = rows.withColumn("due", next_due(F.col("started_at"), F.col("finished_at"), F.col("kind"), F.col("streak"), F.lit(period_minutes), zone=zone))
    last = F.max_by(F.struct("streak", F.col("held").alias("attention_reason"), F.col("since").alias("attention_since"), F.col("due").alias("next_due_at")), F.struct("started_at", "id"))
    return rows.groupBy("source_id").agg(last.alias("x"), F.max(F.when(F.col("kind") == "ok", F.col("finished_at"))).alias("last_success_at")).select("source_id", "x.*", "last_success_at")


def sources_without_state(sources: DataFrame, states: DataFrame, as_of: datetime, zone: str = "Europe/Paris") -> DataFrame:
    """``source_id, next_due_at`` of active sources that have no state: now, or later if their last run says so."""
    lacking = sources.where("is_active").join(states.select("source_id"), "source_id", "left_anti")
    last = F.col("last_crawled_at")
    due = next_due(last, last, F.lit("ok"), F.lit(0), F.col("period_minutes"), zone=zone)
    return lacking.select("source_id", F.greatest(moment(as_of), due).alias("next_due_at"))


def without_match(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no row of ``others`` equals on all ``keys``."""
    return rows.join(others.select(*keys), keys, "left_anti")


def contamination(samples: DataFrame, seen: DataFrame) -> DataFrame:
    """``sample_id, n, n_seen, n_repeated, is_tainted``: a sample is tainted if a hash of it was seen before or occurs in it twice.

    ``samples``: ``sample_id, hash``; ``seen``: ``hash``, any number of times.
    """
    marked = samples.join(seen.select("hash").distinct().withColumn("met", F.lit(1)), "hash", "left")
    told = marked.groupBy("sample_id").agg(F.count("*").alias("n"), F.count("met").alias("n_seen"), (F.count("hash") - F.count_distinct("hash")).alias("n_repeated"))
    return told.withColumn("is_tainted", (F.col("n_seen") > 0) | (F.col("n_repeated") > 0))


def request_key(inputs: dict[str, Column]) -> Column:
    """A fingerprint of effective inputs: the SHA-256 of their JSON with names in order."""
    return F.sha2(F.to_json(F.struct(*[inputs[n].alias(n) for n in sorted(inputs)])), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """``requests`` (with ``key``) and ``response``: the newest one stored within ``days``, or null."""
    fresh = cache.where(F.col("stored_at").between(moment(as_of - timedelta(days=days)), moment(as_of)))
    last = fresh.groupBy("key").agg(F.max_by("response", F.struct("stored_at", "id")).alias("response"))
    return requests.join(last, "key", "left")


#: Buckets of hashes in which keys are counted; one that holds this many times the mean is heavy, so fewer than one in ``HEAVY`` are.
KEY_BUCKETS, HEAVY = 1 << 16, 100


def left_join_spread(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The left join of ``rows`` with ``other`` on ``key``, without one task for a key that very many rows have.

    Rows are counted by buckets of hashes of their keys. Those of heavy buckets stay where they are, and what
    ``other`` has in these few buckets (under one in ``HEAVY`` of them all) goes to them; the rest is joined by key.
    """
    bucket = F.pmod(F.xxhash64(F.col(key).cast(rows.schema[key].dataType)), F.lit(KEY_BUCKETS))
    counts = rows.groupBy(bucket.alias("bucket")).count()
    mean = F.sum("count").over(Window.partitionBy()) / KEY_BUCKETS
    heavy = [r.bucket for r in counts.withColumn("mean", mean).where((F.col("count") > HEAVY * F.col("mean")) & (F.col("count") > KEY_BUCKETS)).select("bucket").collect()]
    if not heavy:
        return rows.join(other, key, "left")
    here = bucket.isin(heavy)
    spread = rows.where(here).join(F.broadcast(other.where(here)), key, "left")
    return spread.unionByName(rows.where(~here).join(other.where(~here), key, "left"))


def stale_inputs(results: DataFrame, current: DataFrame, key: str, bindings: list[str]) -> DataFrame:
    """``id, stale``: results with the bindings that no longer match the current row; all of them where the row is gone."""
    both = left_join_spread(results, current.select(key, F.struct(*bindings).alias("now")), key)
    differ = F.array_compact(F.array(*[F.when(F.col("now").isNull() | ~F.col(b).eqNullSafe(F.col(f"now.{b}")), F.lit(b)) for b in bindings]))
    return both.select("id", differ.alias("stale")).where(F.size("stale") > 0)


def first_after(rows: DataFrame, cutoffs: DataFrame, key: str, number: str) -> DataFrame:
    """Per key the row with the least ``number`` above the key's ``cutoff``."""
    rest = [c for c in rows.columns if c != key]
    after = rows.join(cutoffs.select(key, "cutoff"), key).where(F.col(number) > F.col("cutoff"))
    return after.groupBy(key).agg(F.min_by(F.struct(*rest), number).alias("x")).select(key, "x.*")


def effective_policy(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """``source_id, state``: of the latest policy against the source as it is: effective, stale, revoked or unconfigured.

    ``policies``: ``source_id, generation, fingerprint, is_revoked``.
    """
    last = latest_per_key(policies.select("source_id", "generation", F.col("fingerprint").alias("bound"), "is_revoked"), ["source_id"], "generation")
    both = sources.join(last, "source_id", "left")
    state = F.when(F.col("generation").isNull(), "unconfigured").when(F.col("is_revoked"), "revoked").when(~F.col("bound").eqNullSafe(F.col("fingerprint")), "stale").otherwise("effective")
    return both.select("source_id", state.alias("state"))


def history_state(rows: DataFrame, markers: DataFrame, key: str, number: str) -> DataFrame:
    """``key, n, state``: tracked if the numbers are 1 to the marker's without a gap or repeat, else incomplete;
    unavailable without rows for a marker, unconfigured without a marker."""
    told = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("n_distinct"))
    both = told.join(markers.select(key, "marker"), key, "full_outer")
    whole = (F.col("low") == 1) & (F.col("high") == F.col("marker")) & (F.col("n") == F.col("marker")) & (F.col("n_distinct") == F.col("n"))
    state = F.when(F.col("marker").isNull(), "unconfigured").when(F.col("n").isNull(), "unavailable").when(whole, "tracked").otherwise("incomplete")
    return both.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), state.alias("state"))


def decision_history(decisions: DataFrame) -> DataFrame:
    """``profile_id, active, previous`` after all decisions in order of ``id``.

    Approving makes a version active and the one before previous; rolling back swaps the two if there is
    a previous one; retiring leaves none active; a rejection changes neither.
    """
    ordered = F.array_sort(F.collect_list(F.struct("id", "action", "version")))
    start = F.struct(F.lit(None).cast("long").alias("active"), F.lit(None).cast("long").alias("previous"))
    pair = lambda a, b: F.struct(a.alias("active"), b.alias("previous"))

    def step(s: Column, d: Column) -> Column:
        none = F.lit(None).cast("long")
        back = (d["action"] == "rollback") & s["previous"].isNotNull()
        return F.when(d["action"] == "approve", pair(d["version"], s["active"])).when(back, pair(s["previous"], s["active"])).when(d["action"] == "retire", pair(none, s["active"])).otherwise(s)

    folded = decisions.groupBy("profile_id").agg(F.aggregate(ordered, start, step).alias("x"))
    return folded.select("profile_id", "x.active", "x.previous")
