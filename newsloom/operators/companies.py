"""Companies: search, counts, sentiment, the ecosystem map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.reader import holds

SENTIMENTS = ("positive", "neutral", "negative")


def search_companies(companies: DataFrame, term: str | None = None, sector: str | None = None, map_only: bool = False, rejected: bool = False) -> DataFrame:
    """Companies by text in name or sector, exact sector, and map flag; rejected ones only if asked."""
    out = companies if rejected else companies.where("review_status <> 'rejected'")
    out = out.where(holds(F.col("name"), term) | holds(F.col("sector"), term)) if term else out
    out = out.where(F.col("sector") == sector) if sector else out
    return out.where("is_map") if map_only else out


def article_counts(companies: DataFrame, mentions: DataFrame) -> DataFrame:
    """Approved map companies with their number of mentions, zero kept."""
    counts = mentions.groupBy("company_id").agg(F.count("*").alias("n"))
    shown = companies.where("is_map and review_status = 'approved'")
    return shown.join(counts, F.col("id") == F.col("company_id"), "left").select("id", "name", "sector", "entity_type", F.coalesce("n", F.lit(0)).cast("long").alias("n_articles"))


def sentiment_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("company_id").agg(*[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS])


def sentiment_trend(mentions: DataFrame, articles: DataFrame, weeks: int = 12) -> DataFrame:
    """Per company the latest weeks (from Monday) that have a mention, with its counts by sentiment."""
    dated = mentions.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    by_week = dated.groupBy("company_id", F.to_date(F.date_trunc("week", "published_at")).alias("week")).agg(*[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS])
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("week")))
    return by_week.withColumn("rank", rank).where(F.col("rank") <= weeks).drop("rank")


def ecosystem_map(counted: DataFrame) -> DataFrame:
    """Groups of the map: institutions by their type, others by sector; companies by name."""
    group = F.when(F.col("entity_type") == "school", "Schools").when(F.col("entity_type") == "support", "Support").otherwise(F.coalesce("sector", F.lit("Uncategorized")))
    listed = F.array_sort(F.collect_list(F.struct("name", "id", "n_articles")))
    return counted.groupBy(group.alias("group")).agg(F.count("*").alias("n_companies"), F.sum("n_articles").alias("n_articles"), F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("names"))
