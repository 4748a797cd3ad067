"""Search, highlight feeds, paging and processing state of articles."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment

#: The weight of each highlight tag; any other tag weighs nothing.
WEIGHTS = {"tech_breakthrough": 4, "local_research": 3, "investment": 2, "local_event": 1}


def day_range(moment: Column, first: str | None, last: str | None) -> Column:
    """Whole days from ``first`` to ``last``; a bound that is no date sets no limit."""
    told = F.lit(True)
    for text, test in ((first, lambda d: moment >= d.cast("timestamp")), (last, lambda d: moment < F.date_add(d, 1).cast("timestamp"))):
        if text is not None:
            day = F.try_to_date(F.lit(text))
            told = told & F.when(day.isNull(), True).otherwise(test(day))
    return told


def search_articles(articles: DataFrame, source: int | None = None, tag: str | None = None, first: str | None = None, last: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """Articles that pass every given filter; ``among`` holds the ids of a category or company."""
    out = articles.where(day_range(F.col("published_at"), first, last))
    out = out.where(F.col("source_id") == source) if source is not None else out
    out = out.where(F.array_contains("highlights", tag)) if tag is not None else out
    return out.join(among, "id", "left_semi") if among is not None else out


def folded(text: Column) -> Column:
    """For search: neither case nor accents count."""
    return F.collate(text, "UNICODE_CI_AI")


def search_text(texts: DataFrame, term: str, columns: list[str], wildcards: bool = False) -> DataFrame:
    """Rows in which one of the columns holds ``term``, literally unless ``wildcards``."""
    test = (lambda c: F.lower(c).like(f"%{term.lower()}%")) if wildcards else (lambda c: F.contains(folded(F.col(c)), folded(F.lit(term))))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(test(c), F.lit(False))
    return texts.where(hit)


def highlight_score(tags: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(tags, lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(0)))), F.lit(0))


def highlight_feed(articles: DataFrame, as_of: datetime, days: int = 30, event_days: int = 7) -> DataFrame:
    """Articles with a priority tag in its window, once each, with their score over all tags."""
    recent = (F.col("published_at") >= moment(as_of - timedelta(days=days))) & (F.col("published_at") <= moment(as_of))
    ahead = F.col("event_date") >= F.lit(as_of.date())
    fresh = F.col("event_date").isNull() & (F.col("published_at") >= moment(as_of - timedelta(days=event_days)))
    priority = F.arrays_overlap("highlights", F.array(*map(F.lit, ("tech_breakthrough", "local_research", "investment")))) & recent
    event = F.array_contains("highlights", "local_event") & F.coalesce(ahead | fresh, F.lit(False))
    return articles.where(priority | event).withColumn("score", highlight_score(F.col("highlights")))


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows; beyond the last page there are none. ``order`` must be total."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def top_insights(articles: DataFrame, as_of: datetime, days: int = 3, n: int = 15) -> DataFrame:
    scored = articles.where(F.col("published_at") >= moment(as_of - timedelta(days=days))).withColumn("score", highlight_score(F.col("highlights")))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc("published_at"), F.desc("id")).limit(n)


def unprocessed_without_job(articles: DataFrame, active_jobs: DataFrame) -> DataFrame:
    return articles.where(~F.col("processed")).join(active_jobs.select(F.col("article_id").alias("id")), "id", "left_anti")


def newest_per_key(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def dedup_batch(rows: DataFrame, keys: list[str], order: list[Column], stored: DataFrame | None = None) -> DataFrame:
    """The first row of each key in a batch, unless its key is stored already."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")
    return first.join(stored, keys, "left_anti") if stored is not None else first
