"""Shared pieces of the training-data operators: scratch space, word scanning, hashing.

Words are maximal runs of bytes outside space and ``\\t``..``\\r``; every such run is valid
UTF-8 because the separators are ASCII.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 class of the characters between words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text that are scanned at once inside a task.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on this machine alone (tests) may name none; a temporary folder is made for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Folders that this process has written to the shared folder and not discarded.
MADE: list[str] = []
_NOTED: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders, in order, that this thread writes to the shared folder inside the block."""
    paths: list[str] = []
    outer = _NOTED.get()
    _NOTED.set((*outer, paths))
    try:
        yield paths
    finally:
        _NOTED.set(outer)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in (MADE, *_NOTED.get()):
        paths.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders whose readers are done."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, ``stored``; the folders that it wrote on the way go."""
    with noted() as paths:
        made = make()
    out = stored(made, name)
    discard(spark, [p for p in paths if p in MADE])
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out by key, whatever their sizes are thought to be.

    Spark judges a table by its compressed files and does not count the rows that ``explode`` and ``inline`` add, so a side
    that grows with the input can pass for small, by a factor of over 100, and be sent whole through the driver.
    """
    return df.hint("merge")


def bucketed(df: DataFrame, n: int, keys: list[str], name: str) -> DataFrame:
    """``df`` in the shared folder, in ``n`` buckets of ``keys``, so that later joins on them read it in place.

    The catalogue forgets the table at once; its files stay until they are discarded.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, *keys).option("path", scratch(spark, name)).option("compression", "zstd").saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return held


def aside(docs: DataFrame) -> DataFrame:
    """``row, text``: the other columns of ``docs`` in one struct, whatever their names and types, beside the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))


def restored(columns: list[str]) -> list[Column]:
    """The columns that ``aside`` set aside, in their order, with the text as it is by then."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_column(text: Column) -> Column:
    """The words of a text as an array, in order; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(none)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    sizes = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = sizes[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Slices of rows of about ``limit`` bytes each; a longer row stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the number of words of each row; ``within`` tells for each byte whether words hold it."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if within is None else within[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        first = offsets[:-1]
        before[first[first < len(data)]] = False
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return starts, ends, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` numbers of the splitmix64 sequence of a seed."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of ranges of a sequence, from running sums of a polynomial modulo 2^64."""

    def __init__(self, seed: int):
        self.base = int(stream(seed, 1)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up, self.down

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
            return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTES = stream(11, 256)
_BY_BYTE = Rolling(12)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word; works in spans so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + span, side="right")))
        low = starts[at]
        out[at:to] = _BY_BYTE.ranges(_BYTES[data[low : ends[to - 1]]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out
