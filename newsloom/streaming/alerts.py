"""Keyword alerts on articles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from newsloom.operators.alerts import keyword_matches
from newsloom.streaming.batches import write_batch, written_before

ALERT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("article_id", T.LongType()), T.StructField("keyword", T.StringType()), T.StructField("crawled_at", T.TimestampType())])


def alert_batch(batch: DataFrame, batch_id: int, subscriptions: DataFrame, columns: tuple[str, ...], store: str, hours: int) -> None:
    """Match a batch of articles against the subscriptions; a user hears of an article once within ``hours`` of its crawls."""
    met = keyword_matches(subscriptions, batch, columns).join(batch.groupBy("article_id").agg(F.max("crawled_at").alias("crawled_at")), "article_id")
    least = batch.agg((F.min("crawled_at") - F.make_interval(hours=F.lit(hours))).alias("since"))
    # only what can still repeat is read back
    told = written_before(batch.sparkSession, store, ALERT, batch_id).join(F.broadcast(least), F.col("crawled_at") >= F.col("since")).groupBy("user_id", "article_id").agg(F.max("crawled_at").alias("told_at"))
    again = (F.col("crawled_at") - F.make_interval(hours=F.lit(hours))) <= F.col("told_at")
    new = met.join(told, ["user_id", "article_id"], "left").where(~F.coalesce(again, F.lit(False)))
    write_batch(new.select(ALERT.names), store, batch_id)


def stream_alerts(articles: DataFrame, subscriptions: DataFrame, store: str, checkpoint: str, columns: tuple[str, ...] = ("text",), hours: int = 24) -> StreamingQuery:
    """Start writing ``user_id, article_id, keyword, crawled_at`` for what arrives (``article_id, crawled_at`` and the ``columns``).

    An article that arrives again unchanged goes at once: the stream remembers each version for ``hours``, no longer, by its
    watermark. A changed one is matched anew, and told to users who have not heard of it.
    """
    version = F.xxhash64(*columns)
    fresh = articles.withWatermark("crawled_at", f"{hours} hours").withColumn("version", version).dropDuplicatesWithinWatermark(["article_id", "version"]).drop("version")
    run = lambda batch, n: alert_batch(batch, n, subscriptions, columns, store, hours)
    return fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
