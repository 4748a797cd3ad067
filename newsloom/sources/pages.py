"""Rows from captured pages: links, paragraphs, titles, templates. Patterns run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import collapse_space

#: Elements whose content is no text of the page.
CHROME = ("script", "style", "nav", "header", "footer", "form", "noscript")


def without_chrome(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in CHROME:
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return out


def inner_text(html: Column) -> Column:
    return collapse_space(F.regexp_replace(html, r"<[^>]+>", ""))


def harvest_links(pages: DataFrame, min_length: int = 1, max_length: int = 500) -> DataFrame:
    """``page_id, href, label``: the first link of each address in a page whose label has a fitting length."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    html = F.coalesce("html", F.lit(""))
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("label"))
    rows = pages.select("page_id", F.posexplode(zipped).alias("at", "link")).select("page_id", "at", F.col("link.href").alias("href"), inner_text(F.col("link.label")).alias("label"))
    fit = rows.where((F.length("href") > 0) & F.length("label").between(min_length, max_length))
    return fit.groupBy("page_id", "href").agg(F.min_by("label", "at").alias("label"))


def detail_paragraphs(pages: DataFrame, longer_than: int = 30) -> DataFrame:
    """``page_id, content``: paragraphs of more than ``longer_than`` characters, a blank line between them; null if there are none."""
    found = F.regexp_extract_all(F.coalesce(without_chrome(F.col("html")), F.lit("")), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    kept = F.filter(F.transform(found, inner_text), lambda p: F.length(p) > longer_than)
    return pages.select("page_id", F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).alias("content"))


def link_density(pages: DataFrame, most: float = 0.35) -> DataFrame:
    """``page_id, n_link, n_text, noisy``: characters inside links against all visible ones."""
    body = F.coalesce(without_chrome(F.col("html")), F.lit(""))
    links = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), 1), lambda x: F.length(inner_text(x)))
    counted = pages.select("page_id", F.aggregate(links, F.lit(0), lambda a, x: a + x).alias("n_link"), F.length(inner_text(body)).alias("n_text"))
    return counted.withColumn("noisy", F.col("n_link") > F.col("n_text") * most)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, ``/`` for no path, no fragment; null for other schemes, user info or over 1,000 characters."""
    pattern = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    bare = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    fit = scheme.isin("http", "https") & (host != "") & ~F.contains(host, F.lit("@")) & (F.length(url) <= 1000)
    return F.when(fit, F.concat(scheme, F.lit("://"), bare, path, part(4)))


def match_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """``page_id, template_id, prefix``: the template of the page's host with the longest path prefix.

    A page meets the prefixes of its own path on equality, at most one per character; two templates
    with the same best prefix give none, as an error would.
    """
    url = canonical_url(F.col("url"))
    split = pages.select("page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    met = split.where(F.length("path") > 0).select("page_id", "host", F.explode(prefixes).alias("prefix")).join(templates, ["host", "prefix"])
    best = met.withColumn("longest", F.max(F.length("prefix")).over(Window.partitionBy("page_id"))).where(F.length("prefix") == F.col("longest"))
    return best.groupBy("page_id").agg(F.min("template_id").alias("template_id"), F.min("prefix").alias("prefix"), F.count("*").alias("n")).where("n = 1").drop("n")
