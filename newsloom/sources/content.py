"""Content of captured pages: cleaned bodies, excerpts, resolved addresses, evidence, discovery."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.text import collapse_space
from newsloom.sources.pages import inner_text, without_chrome


def clean_content(value: Column, most_links: float = 0.35) -> Column:
    """``text, error``: paragraphs with their white space collapsed, a blank line between them.

    Of markup the paragraphs count, or all visible text if there are none; where links hold more than
    ``most_links`` of the characters, the text is null and the error ``low_quality``.
    """
    plain = F.array_join(F.filter(F.transform(F.split(value, "\n\n"), collapse_space), lambda p: p != ""), "\n\n")
    body = without_chrome(value)
    links = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), 1), lambda x: F.length(inner_text(x)))
    noisy = F.aggregate(links, F.lit(0), lambda a, x: a + x) > F.length(inner_text(body)) * most_links
    paragraphs = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1), inner_text), lambda p: p != "")
    marked = F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n\n")).otherwise(inner_text(body))
    markup = value.rlike("<[a-zA-Z/!]")
    return F.struct(F.when(~markup, plain).when(~noisy, marked).alias("text"), F.when(markup & noisy, "low_quality").alias("error"))


def website_excerpt(html: Column, most: int = 5000, least: int = 200) -> Column:
    """``excerpt, too_thin``: the first ``most`` characters of the visible text, and whether it has under ``least``."""
    text = inner_text(F.coalesce(without_chrome(html), F.lit("")))
    return F.struct(F.substring(text, 1, most).alias("excerpt"), (F.length(text) < least).alias("too_thin"))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def join(b, h):
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([join(b, h) if isinstance(b, str) and isinstance(h, str) else None for b, h in zip(base, href)], dtype="object")


def resolve_url(base: Column, href: Column) -> Column:
    """The address that a link in a page leads to; null if it is not http(s). Absolute addresses stay in the JVM."""
    whole = href.rlike(r"^https?://[^/?#\s]+(?:/(?!\.\.?(?:/|$))[^?#\s/.]*)*$")
    found = F.coalesce(F.when(whole, href), _joined(F.when(~whole, base), F.when(~whole, href)))
    return F.when(found.rlike("^(?i:https?)://[^/?#]"), found)


def evidence_status(captures: DataFrame, bodies: DataFrame, as_of: datetime) -> DataFrame:
    """``id, status`` of captures ``id, body_hash, expires_at`` against retained ``body_hash, body``.

    ``not_retained`` without a hash, ``expired`` once ``as_of`` has reached its end, ``unavailable`` where no body is kept
    or the kept one has another hash, else ``available``. Bodies have one row for each hash.
    """
    kept = bodies.where(F.sha2("body", 256) == F.col("body_hash")).select("body_hash", F.lit(True).alias("kept"))
    met = captures.join(kept, "body_hash", "left")
    status = F.when(F.col("body_hash").isNull(), "not_retained").when(F.col("expires_at") <= F.lit(as_of), "expired").when(F.col("kept"), "available").otherwise("unavailable")
    return met.select("id", status.alias("status"))


def discovery_report(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``source_id, n_entries, n_new`` of ``source_id, name``: distinct names case aside, and those that ``known`` (``name``) lacks."""
    key = F.lower(collapse_space(F.col("name")))
    named = entries.select("source_id", key.alias("key")).where("key <> ''").distinct()
    held = known.select(key.alias("key"), F.lit(True).alias("held")).distinct()
    return named.join(held, "key", "left").groupBy("source_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("held").isNull()).alias("n_new"))
