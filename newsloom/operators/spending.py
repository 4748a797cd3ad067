"""Money: sessions, settlement, reconciliation, and who is still referred to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ledgers import CLOSED

#: The most that one usage row can hold, and the most tokens that a call can report.
MOST_LOGGED, MOST_TOKENS = 9999.999999, 100_000_000


def session_spend(reservations: DataFrame, usage: DataFrame) -> DataFrame:
    """Money and tokens by session, by source and day, and by day, in one pass; ``level`` is the grouping.

    Closed reservations count at their actual amount, open ones in full; tokens are those used, or what
    was reserved where usage is missing.
    """
    used = usage.select(F.col("id").alias("usage_id"), (F.col("input_tokens") + F.col("output_tokens")).alias("used"))
    money = F.when(F.col("state").isin(*CLOSED), F.col("actual")).otherwise(F.col("reserved"))
    rows = reservations.select("usage_id", "session_id", "source_id", "day", money.alias("money"), (F.col("input_limit") + F.col("output_limit")).alias("limit"))
    # rows without usage have one key, the null, and would all meet in one task of the join
    bare = rows.where("usage_id is null").select("session_id", "source_id", "day", "money", F.col("limit").alias("tokens"))
    met = rows.where("usage_id is not null").join(used, "usage_id", "left").select("session_id", "source_id", "day", "money", F.coalesce("used", "limit").alias("tokens"))
    told = met.unionByName(bare)
    by = told.groupingSets([[F.col("session_id")], [F.col("source_id"), F.col("day")], [F.col("day")]], F.col("session_id"), F.col("source_id"), F.col("day"))
    return by.agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), F.sum("money").alias("spent"), F.sum("tokens").alias("tokens"))


def disproved_ceilings(reservations: DataFrame, usage: DataFrame) -> DataFrame:
    """``provider, model`` whose observed tokens passed a ceiling that was reserved for."""
    used = usage.select(F.col("id").alias("usage_id"), "input_tokens", "output_tokens")
    over = (F.col("input_tokens") > F.col("input_limit")) | (F.col("output_tokens") > F.col("output_limit"))
    return reservations.join(used, "usage_id").where(over).select("provider", "model").distinct()


def settlement(reservations: DataFrame, reports: DataFrame) -> DataFrame:
    """What each pending reservation becomes once its usage is reported: settled, overrun, or unknown.

    Usage is unknown when a number is missing, negative or too large, or the parts do not make the
    total. The cost is rounded up to six places; one too large for a usage row is logged as null.
    """
    both = reservations.where("state = 'reserved'").join(reports, "reservation_id")
    parts = [F.col("prompt_tokens"), F.col("completion_tokens")]
    sound = F.lit(True)
    for n in parts:
        sound = sound & F.coalesce((n >= 0) & (n <= MOST_TOKENS), F.lit(False))
    sound = sound & F.coalesce(F.col("total_tokens") == parts[0] + parts[1], F.col("total_tokens").isNull())
    cost = F.ceil((F.col("input_price") * parts[0] + F.col("output_price") * parts[1]) / 1000, 6)
    over = (parts[0] > F.col("input_limit")) | (parts[1] > F.col("output_limit"))
    state = F.when(~sound, "unknown").when(over, "overrun").otherwise("settled")
    actual = F.when(sound, cost)
    return both.select("reservation_id", state.alias("state"), actual.alias("actual"), F.when(actual <= MOST_LOGGED, actual).alias("logged"))


def reconciled_ledger(reservations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision with its ``outcome``: the first for a reservation applies if the state is still the one it
    expected and open; others are reported as changed, repeated or not found."""
    first = decisions.groupBy("reservation_id").agg(F.min("decision_id").alias("first"))
    held = reservations.select("reservation_id", "state")
    both = decisions.join(first, "reservation_id").join(held, "reservation_id", "left")
    open_ = F.col("state").isin("reserved", "unknown", "overrun")
    outcome = F.when(F.col("state").isNull(), "not found").when(F.col("decision_id") != F.col("first"), "repeated").when(open_ & (F.col("state") == F.col("expected_state")), "reconciled").otherwise("changed")
    return both.select("decision_id", "reservation_id", outcome.alias("outcome"), F.when(outcome == "reconciled", F.col("final_cost")).alias("actual"))


def usage_by_provider(usage: DataFrame, configs: DataFrame) -> DataFrame:
    """Calls and cost by provider and model; ``configs`` is a table of settings, some rows."""
    told = usage.join(configs.select(F.col("id").alias("config_id"), "provider", "model"), "config_id")
    return told.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("cost_cents").alias("cost_cents"))


def referenced_rows(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """``rows`` with ``is_referenced``: whether any of the one-column tables names their key."""
    every = references[0].toDF(key)
    for r in references[1:]:
        every = every.unionByName(r.toDF(key))
    return rows.join(every.where(F.col(key).isNotNull()).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("is_referenced", F.col("hit").isNotNull()).drop("hit")
