"""Feeds: items of RSS and Atom texts, and what state each feed is in. Spark's own XML reader parses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: items that one feed may have.
MOST_ITEMS = 200
_RSS = "struct<title:string,link:string,guid:string,description:string,encoded:string,author:string,pubDate:string,enclosure:array<struct<_url:string,_type:string>>>"
_ATOM = "struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,summary:string,content:string,author:struct<name:string>,published:string,updated:string>"
# the column of broken texts comes last: the reader misplaces the others behind it
_FEED = f"struct<_version:string,channel:struct<title:string,item:array<{_RSS}>>,title:string,entry:array<{_ATOM}>,_corrupt_record:string>"


def _parsed(body: Column) -> Column:
    # prefixes go: `content:encoded` is read as `encoded`
    bare = F.regexp_replace(body, r"<(/?)content:encoded", "<$1encoded")
    return F.from_xml(bare, _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"})


def _root(body: Column) -> Column:
    return F.lower(F.regexp_extract(body, r"(?s)\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([A-Za-z]+)[\s>]", 1))


def _items(feed: Column) -> Column:
    return F.coalesce(F.size(feed["channel"]["item"]), F.lit(0)) + F.coalesce(F.size(feed["entry"]), F.lit(0))


def feed_status(feeds: DataFrame) -> DataFrame:
    """``feed_id, status, n_items`` of each row of ``feed_id, body``.

    ``malformed`` (null, no XML, or another root), ``empty`` (well-formed without items, which is evidence of no
    change), ``too_many`` or ``items``.
    """
    read = feeds.select("feed_id", _root(F.col("body")).alias("root"), _parsed(F.col("body")).alias("feed"))
    n = F.greatest(_items(F.col("feed")), F.lit(0))
    broken = F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull() | ~F.coalesce(F.col("root").isin("rss", "feed"), F.lit(False))
    return read.select("feed_id", F.when(broken, "malformed").when(n == 0, "empty").when(n > MOST_ITEMS, "too_many").otherwise("items").alias("status"), F.when(broken, 0).otherwise(n).alias("n_items"))


def feed_date(text: Column) -> Column:
    """The time of a mail-style or ISO date, null for any other text."""
    mail = F.regexp_replace(F.regexp_replace(F.btrim(text), r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC|UT|Z)$", "+0000")
    iso = F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.btrim(text)))
    return F.coalesce(F.when(mail.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))), iso)


def scan_feed(feeds: DataFrame) -> DataFrame:
    """``feed_id, position, title, url, external_id, content, author, image_url, published_at`` of each item with a title and a link.

    The full content counts before the summary; an item without an id is known by a hash of its link; malformed
    feeds have no items.
    """
    feed = _parsed(F.col("body"))
    rss = F.transform(
        feed["channel"]["item"],
        lambda x: F.struct(
            x["title"].alias("title"), x["link"].alias("url"), x["guid"].alias("id"), F.coalesce(x["encoded"], x["description"]).alias("content"), x["author"].alias("author"),
            F.try_element_at(F.filter(x["enclosure"], lambda e: e["_type"].startswith("image/")), F.lit(1))["_url"].alias("image_url"), x["pubDate"].alias("date"),
        ),
    )
    own = lambda x: F.filter(x["link"], lambda e: F.coalesce(e["_rel"], F.lit("alternate")) == "alternate")
    atom = F.transform(
        feed["entry"],
        lambda x: F.struct(
            x["title"].alias("title"), F.try_element_at(own(x), F.lit(1))["_href"].alias("url"), x["id"].alias("id"), F.coalesce(x["content"], x["summary"]).alias("content"),
            x["author"]["name"].alias("author"), F.lit(None).cast("string").alias("image_url"), F.coalesce(x["published"], x["updated"]).alias("date"),
        ),
    )
    items = F.when(feed["_corrupt_record"].isNull(), F.coalesce(rss, atom))
    rows = feeds.select("feed_id", F.posexplode(items).alias("position", "x")).select("feed_id", "position", F.btrim("x.title").alias("title"), F.btrim("x.url").alias("url"), "x.id", "x.content", "x.author", "x.image_url", "x.date")
    named = F.coalesce(F.when(F.col("id") != "", F.col("id")), F.substring(F.sha2("url", 256), 1, 32))
    return rows.where("title <> '' AND url <> ''").select("feed_id", "position", "title", "url", named.alias("external_id"), "content", "author", "image_url", feed_date(F.col("date")).alias("published_at"))
