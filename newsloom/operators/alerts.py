"""Keyword subscriptions against articles.

A keyword is anchored by its first 1, 2, 4, 8 or 16 bytes, the longest of these that it has. Texts are scanned once, all
places at a time: the bytes at a place are hashed at each of these lengths and looked up in a bit table of fixed size
that is built from all anchors. What passes meets the keywords on the anchor, by a join, and brings along as many bytes
of text as the longest keyword has, so that the test on the whole keyword needs no text. The work is linear in the
texts, whatever the keywords.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.times import moment

#: Lengths of anchors in bytes, each twice the one before.
ANCHORS = (1, 2, 4, 8, 16)
#: The bit table has this many bits (a power of two): its size does not depend on how many keywords there are.
TABLE_BITS = 26
#: Bytes of text that are scanned at once.
SCANNED = 1 << 20
#: Articles of a block, as bits of their number: a place in a block is two bytes.
BLOCK_BITS = 12


def unique_keywords(lists: DataFrame, most: int = 50, longest: int = 200, stored: DataFrame | None = None) -> DataFrame:
    """``user_id, keyword`` of comma lists: trimmed, the first of equal ones, at most ``most`` a user.

    Of a user who has ``stored`` subscriptions (``user_id, keyword``) only what is new counts, up to the rest of ``most``.
    """
    parts = F.filter(F.transform(F.split("keywords", ","), lambda k: F.btrim(k)), lambda k: (F.length(k) > 0) & (F.length(k) <= longest))
    if stored is None:
        return lists.select("user_id", F.explode(F.slice(F.array_distinct(parts), 1, most)).alias("keyword"))
    held = stored.groupBy("user_id").agg(F.collect_set("keyword").alias("held"))  # at most ``most`` of a user
    both = lists.join(held, "user_id", "left")
    none = F.array().cast("array<string>")
    new = F.array_except(F.array_distinct(parts), F.coalesce("held", none))
    room = F.greatest(F.lit(0), most - F.size(F.coalesce("held", none)))
    return both.select("user_id", F.explode(F.slice(new, F.lit(1), room)).alias("keyword"))


def _hashed(x: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors_at(data: np.ndarray, lengths: tuple[int, ...] = ANCHORS) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hash of that many bytes at each place that has them."""
    wide = data.astype(np.uint64)
    for length in ANCHORS:
        if length > len(data):
            return
        if length > 1:
            half = length // 2
            first, second = wide[:-half], wide[half:]
            # up to 8 bytes fit side by side; 16 are two of these, mixed
            wide = first | second << np.uint64(8 * half) if length <= 8 else _hashed(first, 99) ^ second
        if length in lengths:
            yield length, _hashed(wide, length)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in the bit table."""
    return hashes >> np.uint64(64 - TABLE_BITS), hashes >> np.uint64(64 - 2 * TABLE_BITS) & np.uint64((1 << TABLE_BITS) - 1)


def _anchored(words: DataFrame) -> DataFrame:
    """``word, anchor, length, b0, b1``: the anchor of each word and its places in the bit table."""

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                held = word.encode()
                length = max(x for x in ANCHORS if x <= len(held))
                found += [(length, h[0]) for _, h in anchors_at(np.frombuffer(held[:length], np.uint8), (length,))]
            anchors = np.array([h for _, h in found], np.uint64)
            columns = [anchors.view(np.int64), np.array([n for n, _ in found], np.int32), *(x.astype(np.int64) for x in _bits(anchors))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["word", "anchor", "length", "b0", "b1"])

    return words.select("word").mapInArrow(hash_words, "word string, anchor long, length int, b0 long, b1 long")


def text_places(texts: DataFrame, anchored: DataFrame) -> DataFrame:
    """``article_id, anchor, ahead``: distinct places of ``article_id, body`` that may begin a word, with the bytes from there."""
    spark = texts.sparkSession
    places = anchored.select("length", F.octet_length("word").alias("size"), F.explode(F.array("b0", "b1")).alias("b"))
    told = places.groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"), F.bit_or("length").alias("lengths"), F.max("size").alias("size"))
    told = told.toArrow()  # no more rows than the table has words
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[told.column("at").to_numpy()] = told.column("bits").to_numpy()
    longest = int(told.column("size").to_numpy().max(initial=0))
    held = int(np.bitwise_or.reduce(told.column("lengths").to_numpy(), initial=0))
    lengths = tuple(x for x in ANCHORS if x & held)
    shared = spark.sparkContext.broadcast(table.view(np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids, anchors, ahead = [], [], []
            for row, text in enumerate(batch.column("body")):
                held = text.as_py()
                for low in range(0, len(held), SCANNED):
                    part = np.frombuffer(held, np.uint8)[low : low + SCANNED + ANCHORS[-1] - 1]
                    seen = set()
                    for _, hashes in anchors_at(part, lengths):
                        first, second = _bits(hashes[:SCANNED])
                        at = np.flatnonzero(bits[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
                        at = at[(bits[second[at] >> np.uint64(3)] >> (second[at] & np.uint64(7)).astype(np.uint8) & 1) > 0]
                        seen.update((h, held[low + i : low + i + longest]) for i, h in zip(at.tolist(), hashes[at].view(np.int64).tolist()))
                    ids += [row] * len(seen)
                    anchors += [h for h, _ in seen]
                    ahead += [x for _, x in seen]
            yield pa.RecordBatch.from_arrays([batch.column("article_id").take(pa.array(ids, pa.int64())), pa.array(anchors, pa.int64()), pa.array(ahead, pa.binary())], ["article_id", "anchor", "ahead"])

    kind = texts.schema["article_id"].dataType.simpleString()
    return texts.select("article_id", F.col("body").cast("binary").alias("body")).mapInArrow(scan, f"article_id {kind}, anchor long, ahead binary")


def keyword_matches(subscriptions: DataFrame, articles: DataFrame, columns: tuple[str, ...] = ("text",), as_of: datetime.datetime | None = None, hours: int = 24) -> DataFrame:
    """``user_id, article_id, keyword`` where one of the ``columns`` holds the keyword, case aside; one row per user
    and article, the smallest subscription wins.

    With ``as_of``, only articles that were crawled (``crawled_at``) in the ``hours`` before it count. Users join last.
    """
    if as_of is not None:
        articles = articles.where(F.col("crawled_at") >= moment(as_of) - F.make_interval(hours=F.lit(hours)))
    subs = subscriptions.where(F.length("keyword") > 0).select("user_id", "subscription_id", F.lower("keyword").alias("word"), F.col("keyword"))
    anchored = _anchored(subs.select("word").distinct())
    texts = articles.select("article_id", F.explode(F.array(*columns)).alias("body")).where(F.length("body") > 0).select("article_id", F.lower("body").alias("body"))
    met = text_places(texts, anchored).join(anchored.select("anchor", "word"), "anchor")
    held = met.where(F.startswith("ahead", F.col("word").cast("binary"))).select("article_id", "word")
    return _first_keywords(held, subs)


def _first_keywords(held: DataFrame, subs: DataFrame) -> DataFrame:
    """``user_id, article_id, keyword`` of the words that articles hold (``article_id, word``) and users wait for.

    Articles go in blocks: of each word, a block's articles are one short array, and a user meets whole blocks. So what is
    shuffled are two bytes for each match, not a row, and the first keyword is chosen inside one user's block.
    """
    kind = held.schema["article_id"].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType))
    a = F.col("article_id")
    if whole:
        block, at = F.shiftright(a.cast("long"), BLOCK_BITS), a.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("short")
        back = lambda x: F.col("block") * (1 << BLOCK_BITS) + x
    else:
        block, at, back = F.pmod(F.xxhash64(a), F.lit(1 << BLOCK_BITS)), a, lambda x: x
    # in order, so that equal blocks look alike
    blocks = held.groupBy("word", block.alias("block")).agg(F.array_sort(F.collect_set(at)).alias("at"))
    met = blocks.join(subs, "word").groupBy("user_id", "block").agg(F.array_sort(F.collect_list(F.struct("subscription_id", "keyword", "at"))).alias("words"))
    listed = T.ArrayType(blocks.schema["at"].dataType.elementType)
    part = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("at", listed)])
    start = F.struct(F.array().cast(listed).alias("seen"), F.array().cast(T.ArrayType(part)).alias("parts"))

    def take(state, w):
        new = F.array_except(w["at"], state.seen)
        return F.struct(F.concat(state.seen, new).alias("seen"), F.concat(state.parts, F.array(F.struct(w.keyword.alias("keyword"), new.alias("at")))).alias("parts"))

    parts = met.select("user_id", "block", F.explode(F.aggregate("words", start, take, lambda s: s.parts)).alias("p"))
    told = parts.select("user_id", "block", F.col("p.keyword").alias("keyword"), F.explode("p.at").alias("x"))
    return told.select("user_id", back(F.col("x")).cast(kind).alias("article_id"), "keyword")


def keyword_alerts(matches: DataFrame) -> DataFrame:
    """Per user with a match, how many articles and the newest of them."""
    return matches.groupBy("user_id").agg(F.count("*").alias("n_articles"), F.max("article_id").alias("last_article"))
