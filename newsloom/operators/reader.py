"""What readers and operators of the site ask: pages of lists, details, digests, API documents.

Lists end their order with the id, so pages are the same in every run. Texts compare without case or
accents (``articles.folded``); a null text holds nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment
from newsloom.operators.articles import folded, highlight_score, newest_per_key


def holds(text: Column, term: str) -> Column:
    """Whether a text holds ``term``, literally, case and accents aside."""
    return F.coalesce(F.contains(folded(text), folded(F.lit(term))), F.lit(False))


def search_articles_api(articles: DataFrame, term: str | None = None, source: int | None = None) -> DataFrame:
    """Articles by source and by text in the French or Chinese title."""
    out = articles.where(F.col("source_id") == source) if source is not None else articles
    return out.where(holds(F.col("title_fr"), term) | holds(F.col("title_zh"), term)) if term else out


def search_companies_api(companies: DataFrame, mentions: DataFrame, term: str | None = None, sector: str | None = None) -> DataFrame:
    """Companies of any review state by text in the name, with their number of mentions, zero kept."""
    out = companies.where(holds(F.col("name"), term)) if term else companies
    out = out.where(F.col("sector") == sector) if sector else out
    counts = mentions.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return out.join(counts, "id", "left").withColumn("n_articles", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def admin_articles(articles: DataFrame, processed: bool | None = None, source: int | None = None, term: str | None = None, titles: tuple[str, ...] = ("title_fr", "title_zh", "title_en")) -> DataFrame:
    """Articles by state, source and text in a title."""
    out = articles.where(F.col("processed") == processed) if processed is not None else articles
    out = out.where(F.col("source_id") == source) if source is not None else out
    if term:
        hit = F.lit(False)
        for c in titles:
            hit = hit | holds(F.col(c), term)
        out = out.where(hit)
    return out


def admin_companies(companies: DataFrame, status: str | None = None, term: str | None = None) -> DataFrame:
    """Companies by review state and text in the name, each with how many wait for review in all."""
    waiting = companies.agg(F.count_if(F.col("review_status") == "pending").alias("n_pending"))  # one row
    out = companies.where(F.col("review_status") == status) if status else companies
    out = out.where(holds(F.col("name"), term)) if term else out
    return out.join(F.broadcast(waiting), F.lit(True))


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").orderBy("name", "id")


def localized(field: str, language: Column, languages: tuple[str, ...] = ("zh", "en")) -> Column:
    """The field in the reader's language; empty or missing falls back to French, then to nothing."""
    own = F.coalesce(*[F.when(language == x, F.nullif(F.col(f"{field}_{x}"), F.lit(""))) for x in languages])
    return F.coalesce(own, F.nullif(F.col(f"{field}_fr"), F.lit("")), F.lit(""))


def best_overview(overview: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(overview, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))


def all_names(name: Column, aliases: Column) -> Column:
    return F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))


def article_detail(articles: DataFrame, mentions: DataFrame, companies: DataFrame, categories: DataFrame) -> DataFrame:
    """Each article with its companies (by id) and its categories (by slug) as sorted arrays, empty where there are none."""
    named = mentions.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id")
    own = named.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("company_id", "name", "sentiment"))).alias("companies"))
    tags = categories.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    out = articles.join(own, "id", "left").join(tags, "id", "left")
    none = F.array().cast("array<struct<company_id:bigint,name:string,sentiment:string>>")
    return out.withColumns({"companies": F.coalesce("companies", none), "categories": F.coalesce("categories", F.array().cast("array<string>"))})


def articles_with_category(articles: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    return articles.join(categories.where(F.col("category") == category).select(F.col("article_id").alias("id")), "id", "left_semi")


def api_document(columns: dict[str, Column]) -> Column:
    """The JSON document of a row; missing values are null in it."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def article_document() -> Column:
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    plain = {n: F.col(n) for n in ("id", "url", "title_fr", "author")}
    return api_document(plain | {"published_at": time, "llm_processed": F.col("processed"), "content_level": unknown("content_level"), "source_language": unknown("source_language")})


def daily_digest(articles: DataFrame, as_of: datetime, hours: int = 24, languages: tuple[str, ...] = ("zh", "fr", "en")) -> DataFrame:
    """``language, section, rank, id, title``: the articles of a day in each language, once, whoever reads them.

    Section ``top`` has the scored articles by score and time, ``rest`` the others by time.
    """
    recent = articles.where((F.col("crawled_at") >= moment(as_of - timedelta(hours=hours))) & (F.col("crawled_at") <= moment(as_of)))
    scored = recent.withColumn("score", highlight_score(F.col("highlights"))).withColumn("section", F.when(F.col("score") > 0, "top").otherwise("rest"))
    order = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("published_at"), F.desc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    told = ranked.withColumn("language", F.explode(F.array(*map(F.lit, languages))))
    return told.select("language", "section", "rank", "id", localized("title", F.col("language")).alias("title"))


def digest_readers(digest: DataFrame, subscribers: DataFrame) -> DataFrame:
    """``user_id, language, n_articles`` of each active subscriber who wants the digest, none if there is no article in the reader's language."""
    wanted = subscribers.where("is_active and wants_digest").select("user_id", F.coalesce("language", F.lit("zh")).alias("language"))
    return wanted.join(digest.groupBy("language").agg(F.count("*").alias("n_articles")), "language").select("user_id", "language", "n_articles")


def digest_with_readers(digest: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The whole digest of every subscriber: the rows of ``daily_digest`` and, as section ``reader``, a row for each subscriber.

    A reader's digest is what the reader's language has in the other sections, ``n_articles`` in all; readers of one language get
    the same lists, so these are not repeated for each.
    """
    readers = digest_readers(digest, subscribers).withColumn("section", F.lit("reader"))
    return digest.unionByName(readers, allowMissingColumns=True)


def dashboard(articles: DataFrame, companies: DataFrame, sources: DataFrame, usage: DataFrame, as_of: datetime) -> DataFrame:
    """One row of counts, and the cost of the day so far."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    today = (F.col("created_at") >= moment(day)) & (F.col("created_at") <= moment(as_of))
    rows = [
        sources.agg(F.count_if("is_active").alias("n_sources")),
        articles.agg(F.count("*").alias("n_articles"), F.count_if(~F.col("processed")).alias("n_unprocessed")),
        companies.agg(F.count("*").alias("n_companies"), F.count_if("is_map").alias("n_map")),
        usage.where(today).agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cost_today")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(row, F.lit(True))  # one row each
    return out


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def due_sources(states: DataFrame, as_of: datetime, limit: int = 50) -> DataFrame:
    """Active sources that are due, not paused and held by no live lease, the longest due first."""
    now = moment(as_of)
    free = F.col("claim_id").isNull() | (F.col("lease_expires_at") <= now)
    return states.where(F.col("is_active") & F.col("paused_at").isNull() & (F.col("next_due_at") <= now) & free).orderBy("next_due_at", "source_id").limit(limit)


def reservation_list(reservations: DataFrame, closed: tuple[str, ...], limit: int = 100) -> DataFrame:
    """Open reservations before closed ones, newest first."""
    return reservations.orderBy(F.col("state").isin(*closed), F.desc("created_at"), F.desc("id")).limit(limit)


def stale_list(sources: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Active sources not crawled for a day, those never crawled first."""
    late = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < moment(as_of - timedelta(hours=hours)))
    return sources.where(F.col("is_active") & late).orderBy(F.asc_nulls_first("last_crawled_at"), "id")


def recent(rows: DataFrame, time: str, n: int = 10) -> DataFrame:
    """The ``n`` newest rows of a list."""
    return rows.orderBy(F.desc(time), F.desc("id")).limit(n)


def directories_to_scan(directories: DataFrame, limit: int = 50) -> DataFrame:
    return directories.where("is_active").orderBy(F.asc_nulls_first("last_scanned_at"), "id").limit(limit)


def recent_titles(mentions: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """``company_id, titles``: the last titles of each company, newest first, French else English, a line each."""
    dated = mentions.join(articles.select(F.col("id").alias("article_id"), "published_at", "title_fr", "title_en"), "article_id")
    top = newest_per_key(dated, "company_id", n, F.desc("published_at"), F.desc("article_id"))
    line = F.concat(F.lit("- "), F.coalesce(F.nullif(F.col("title_fr"), F.lit("")), F.col("title_en"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("company_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("titles"))
