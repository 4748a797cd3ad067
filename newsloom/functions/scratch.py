"""Where intermediate results go that must outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session on this machine alone may go without: it gets a temporary folder.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if named is None and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once and written, so that several readers do not work it out again."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()
