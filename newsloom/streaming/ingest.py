"""Articles of a stream merged into a table, batch by batch, safe against replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from newsloom.operators.ledgers import latest_per_key
from newsloom.operators.merges import level_rank, merged_articles
from newsloom.streaming.batches import write_batch, written_before

ARTICLE = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("external_id", "url", "title", "content", "content_level", "author", "image_url", "language")],
        T.StructField("published_at", T.TimestampType()),
        T.StructField("processed", T.BooleanType()),
        T.StructField("id", T.StringType()),
    ]
)


def current_articles(spark: SparkSession, store: str, batch_id: int | None = None) -> DataFrame:
    """The last version of each article, of the batches before ``batch_id`` or of all."""
    return latest_per_key(written_before(spark, store, ARTICLE, batch_id), ["id"], "batch").drop("batch").select(ARTICLE.names)


def ingest_batch(batch: DataFrame, batch_id: int, store: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merge a batch of articles, or of pages that ``extract`` reads articles from, into the ``store``.

    Of several rows of a batch for one article the best level counts, of these the last by content. An article's id is
    made from its source and external id, so that it does not depend on the batch.
    """
    found = extract(batch) if extract else batch
    better = F.struct(level_rank(F.col("content_level"), F.col("content")), "content", "url", "title")
    one = latest_per_key(found.withColumn("better", better), ["source_id", "external_id"], "better").drop("better")
    before = current_articles(batch.sparkSession, store, batch_id)
    made = merged_articles(before, one).drop("action")
    own = F.sha2(F.concat_ws(":", F.col("source_id").cast("string"), "external_id"), 256)
    write_batch(made.withColumn("id", F.coalesce("id", own)), store, batch_id)


def stream_ingest(arriving: DataFrame, store: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start merging what arrives. ``store`` and ``checkpoint`` lie in a folder that all machines share."""
    return arriving.writeStream.foreachBatch(lambda batch, n: ingest_batch(batch, n, store, extract)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
