"""Rules that rows must keep. A check gives the names of the rules that a row breaks, so all are told at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error codes that are tried again, and those that rest for a day; any other is about extraction.
RETRY = ("timeout", "network_error", "server_error", "rate_limited", "database_error", "fetch_closed", "transport_unavailable", "budget_exceeded")
BLOCKED = (
    "forbidden", "robots_denied", "robots_unavailable", "unsafe_url", "tls_error", "login_required", "paywall", "captcha", "http_error",
    "redirect_limit", "schema_stale", "policy_unavailable", "invalid_schema",
)
#: Errors that say a site refuses us, and errors that a later try may mend.
REFUSED = ("forbidden", "robots_denied", "login_required", "paywall", "captcha", "unsafe_url")
PASSING = ("timeout", "network_error", "rate_limited", "server_error", "database_error")


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def is_web_address(url: Column, most: int = 1000) -> Column:
    """An http(s) address with a host, without user info, white space or control characters."""
    return F.coalesce((F.length(url) <= most) & url.rlike(r"\A(?i:https?)://[^/?#@\s\\]+(?:[/?#][^\s\\\x00-\x1f]*)?\z") & ~url.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def classify_error(code: Column) -> Column:
    return F.when(code.isNull(), "ok").when(code.isin(*RETRY), "retry").when(code.isin(*BLOCKED), "blocked").otherwise("extraction")


def classify_http(status: Column) -> Column:
    """The error code of a response; null for success."""
    return (
        F.when(status.isin(401, 403), "forbidden").when(status == 408, "timeout").when(status == 429, "rate_limited").when(status >= 500, "server_error").when(status >= 400, "http_error")
    )


def validate_raw(rows: DataFrame) -> DataFrame:
    """Crawled rows with ``failed_rules``; one bad row voids its whole run (``run_valid``).

    Author and image address are cut to what the store takes.
    """
    text = lambda c, most: (F.length(c) <= most) & (F.length(F.trim(c)) > 0)
    rules = {"title": text(F.col("title"), 500), "url": is_web_address(F.col("url")), "external_id": (F.length("external_id") > 0) & (F.length("external_id") <= 500)}
    told = rows.withColumns({"failed_rules": broken(rules), "author": F.nullif(F.substring("author", 1, 200), F.lit("")), "image_url": F.nullif(F.substring("image_url", 1, 1000), F.lit(""))})
    return told.withColumn("run_valid", F.min(F.size("failed_rules") == 0).over(Window.partitionBy("run_id")))


def article_rules() -> dict[str, Column]:
    """Of an article record: ``provenance`` is the array of its fields that have evidence."""
    has = lambda name, present: ~present | F.array_contains("provenance", name)
    content, date, author = F.col("content").isNotNull(), F.col("published_at").isNotNull(), F.col("author").isNotNull()
    return {
        "external_id": F.length("external_id").between(1, 500),
        "title": F.length("title").between(1, 500) & (F.length(F.trim("title")) > 0),
        "url": is_web_address(F.col("url")),
        "source_language": F.col("source_language").rlike(r"\A(?:unknown|[a-z]{2,3}(?:-[A-Za-z0-9]{2,8}){0,3})\z"),
        "content": ~content | (F.octet_length("content").between(1, 65535)),
        "content_level": F.col("content_level").isin("full", "excerpt", "metadata_only") & (content == (F.col("content_level") != "metadata_only")),
        "published_at_source": F.col("published_at_source").isin("unknown", "feed", "list", "detail", "jsonld", "legacy") & (date == (F.col("published_at_source") != "unknown")),
        "provenance": (F.size("provenance") == F.size(F.array_distinct("provenance"))) & (F.size("provenance") <= 10) & has("title", F.lit(True)) & has("url", F.lit(True)) & has("content", content) & has("published_at", date) & has("author", author),
    }


def counter_rules() -> dict[str, Column]:
    """Of a run's counters and status: what adds up, and what each status demands."""
    n, status = F.col, F.col("status")
    written = n("new") + n("updated")
    none = status.isin("no_change", "inconclusive", "blocked", "failed")
    kept = status.isin("success", "partial", "degraded")
    return {
        "counts": (n("valid") + n("rejected") == n("extracted")) & (n("extracted") <= n("discovered")) & (n("duplicate") + written <= n("valid")),
        "status": status.isin("success", "no_change", "partial", "degraded", "inconclusive", "blocked", "failed"),
        "articles": ~none | (written == 0),
        "kept": ~kept | (n("valid") == written + n("duplicate")),
        "success": (status != "success") | ((written > 0) & (F.size("errors") == 0) & (n("rejected") == 0) & (n("extracted") == n("discovered"))),
        "partial": (status != "partial") | ((n("valid") > 0) & ((n("rejected") > 0) | (F.size("errors") > 0))),
        "degraded": (status != "degraded") | ((n("valid") > 0) & F.array_contains("errors", "low_quality")),
        "failed": (status != "failed") | (F.size("errors") > 0),
        "blocked": (status != "blocked") | F.arrays_overlap("errors", F.array(*map(F.lit, REFUSED))),
    }


def observation_rules() -> dict[str, Column]:
    """Of a fetched page: ``http_status, final_url, snapshot_id, response_bytes, error``."""
    status, error = F.col("http_status"), F.col("error")
    fine = error.isNull()
    good = status.between(200, 299) | (status == 304)
    return {
        "http_status": (status.isNull() | (status.between(100, 599) & F.col("final_url").isNotNull())) & (~fine | F.coalesce(good, F.lit(False))),
        "error": fine | ((~F.coalesce(status.isin(401, 403), F.lit(False)) | error.isin(*REFUSED)) & (~F.coalesce(status == 429, F.lit(False)) | (error == "rate_limited"))),
        "snapshot_id": ~fine | F.coalesce(status == 304, F.lit(False)) | F.col("snapshot_id").isNotNull(),
        "response_bytes": (F.col("response_bytes") >= 0) & (~F.coalesce(status == 304, F.lit(False)) | (F.col("response_bytes") == 0)),
    }


def observation_status() -> Column:
    error = F.col("error")
    return F.when(error.isin(*REFUSED), "blocked").when(error.isin(*PASSING), "retryable_error").when(error.isNotNull(), "failed").when(F.col("http_status") == 304, "not_modified").otherwise("ok")


def content_to_enrich(visible: Column, content: Column, level: Column, title: Column) -> tuple[Column, Column]:
    """The text that enrichment reads, and whether it is a full body. ``visible`` is the body without tags."""
    has_text = F.coalesce(F.length(F.trim(visible)) > 0, F.lit(False))
    return F.when(has_text & ~level.eqNullSafe("metadata_only"), content).otherwise(title), has_text & (level.isNull() | (level == "full"))


def quality_report(items: DataFrame) -> DataFrame:
    """Per run what became of its items: ``outcome`` is rejected, duplicate, new or updated; null if nothing was extracted."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    out = items.groupBy("run_id").agg(F.count("*").alias("discovered"), F.count("outcome").alias("extracted"), is_("duplicate", "new", "updated").alias("valid"), *[is_(x).alias(x) for x in ("duplicate", "new", "updated", "rejected")])
    return out.withColumn("no_change_reason", F.when((F.col("duplicate") == F.col("discovered")) & (F.col("duplicate") > 0), "all_duplicates"))
