"""A table of what the micro-batches of a stream gave, one folder for each, so that a replayed batch changes nothing.

A batch reads only what batches before it wrote and writes its own folder anew, so running it again gives the same
rows in the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def written_before(spark: SparkSession, store: str, schema: T.StructType, batch_id: int | None = None) -> DataFrame:
    """The rows of all batches before ``batch_id`` (all there are without one) with their ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    held = spark.read.schema(full).parquet(store)  # the folder's name gives the batch, so others are not opened
    return held if batch_id is None else held.where(F.col("batch") < batch_id)


def write_batch(rows: DataFrame, store: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
