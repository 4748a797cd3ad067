"""WARC archives: Spark's text writer makes them, a boundary-chain check reads them.

A record is one row of text whose line separator is the blank line that ends a record, so the files
are plain WARC/1.1 (or gzip of it) and no task holds more than a record. Reading splits the files at
the magic line, wherever it stands. Each piece is a candidate record; tasks emit its offset and,
from its Content-Length, the offset of its successor. Pointer jumping from offset zero of each file
keeps the candidates that the chain reaches; a magic line inside a payload is never reached.

Defined results: a null payload is empty; of the rows with equal payloads those with the largest
page_id are responses and the others revisit it, and a null page_id is the smallest (so rows that
repeat the largest id are all responses); an empty table writes no record; other columns take no
part. Payloads are kept whole. Line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import scratch, shared_dir, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 of a string: each five hexadecimal digits make four letters."""
    hexed = F.sha1(payload.cast("binary"))
    four = lambda v: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(fives, four), "")


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to`` of each page.

    The response of each payload is told from digests and ids alone, in a table of its own: Spark can
    then split the join for a payload that very many pages share.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    last = stored(rows.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top")), "warc-responses")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    out = rows.join(last, ["payload_digest", "payload_bytes"])
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("top"))}).drop("top")


def write_warc(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = 50_000) -> None:
    """One WARC record per row of ``typed``. Revisits carry no payload, but its length and digest."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    body = F.when(revisit, "").otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", named("refers_to")))).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    records.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = (("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()))
_SHAPE = "file long, block long, rel long, size long, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def _number(name: str) -> int | None:
    inner = name[len("<urn:page:") : -1]
    return int(inner) if inner else None


def parsed(head: bytes) -> dict[str, str]:
    pairs = (x.split(b": ", 1) for x in head.split(b"\r\n") if b": " in x)
    return {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in pairs}


class Candidate:
    """A piece that follows a magic line, and the bytes that its header says still follow."""

    def __init__(self, place: tuple, piece: bytes):
        self.place, self.size, self.total, self.fields, self.left = place, len(MAGIC) + len(piece), None, (None,) * 5, 0
        self.sha = hashlib.sha1()
        head, blank, body = piece.partition(END.encode())
        fields = parsed(head)
        if not blank or not fields.get("content-length", "").isdigit():
            return
        length = int(fields["content-length"])
        self.total = len(MAGIC) + len(head) + len(END) + length + len(END)
        self.left, self.headers = length, fields
        self.take(body)

    def take(self, more: bytes) -> None:
        self.sha.update(more[: self.left])
        self.left -= min(self.left, len(more))

    def row(self) -> tuple:
        if self.total is None:
            return (*self.place, self.size, None, *self.fields, False)
        f = self.headers
        revisit = f.get("warc-type") == "revisit"
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(self.sha.digest()).decode()
        try:
            page, other = _number(f.get("warc-record-id", "")), _number(f["warc-refers-to"]) if revisit else None
            size = int(f.get("x-payload-length", -1)) if revisit else int(f["content-length"])
        except (ValueError, KeyError):
            return (*self.place, self.size, self.total, *self.fields, self.left == 0)
        return (*self.place, self.size, self.total, page, f.get("warc-type"), other, size, digest, self.left == 0)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each magic line in the archives: its place, its size, what its header says, its payload's digest.

    ``rel`` counts from the first piece of a block of the file that one task reads; pieces stream, so
    a task holds a piece and the digests of records that still lack bytes.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(path)
    pieces = pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))

    def emit(batches):
        where, at, open_records = None, 0, []
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), *_FIELDS, ("whole", pa.bool_())])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = []
            for file, block, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                piece = piece.as_py()
                if (file, block) != where:
                    rows += [c.row() for c in open_records]
                    where, at, open_records = (file, block), 0, []
                    if block == 0:  # what stands before the first magic line
                        at = len(piece)
                        continue
                for c in open_records:
                    c.take(MAGIC.encode() + piece)
                here = Candidate((file, block, at), piece)
                at += here.size
                open_records.append(here)
                rows += [c.row() for c in open_records if not c.left]
                open_records = [c for c in open_records if c.left]
            if rows:
                yield batch_of(rows)
        if open_records:
            yield batch_of([c.row() for c in open_records])

    return pieces.mapInArrow(emit, _SHAPE)


def placed(found: DataFrame) -> DataFrame:
    """``found`` with ``off``, the offset in the file: blocks follow each other."""
    blocks = found.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("size")).alias("bytes"))
    before = blocks.alias("a").join(blocks.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.block") < F.col("a.block")), "left")
    start = before.groupBy("a.file", "a.block").agg(F.coalesce(F.sum("b.bytes"), F.lit(0)).alias("start"))
    return found.join(start, ["file", "block"]).withColumn("off", F.col("start") + F.col("rel")).drop("start", "block", "rel")


def reachable(chain: DataFrame) -> DataFrame:
    """``file, off`` of the records that the chain ``file, off, next`` reaches from offset zero, by pointer jumping."""
    known = chain.where("off = 0").select("file", "off")
    jump = chain.where("next is not null")
    there = chain.select("file", F.col("off").alias("next"))
    jump = jump.join(there, ["file", "next"]).select("file", "off", "next").checkpoint()
    while not jump.isEmpty():
        new = known.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        known = known.union(new).distinct().checkpoint()
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.off")))
        jump = twice.select("a.file", "a.off", "b.next").checkpoint()
    return known


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record that the chain reaches.

    A reached record that ends in another block than its header, with a magic line in its payload, is
    an error: such files are to be read compressed, or with blocks as large as they are.
    """
    shared_dir(spark)
    found = stored(placed(candidates(spark, path)), "warc-candidates")
    chain = found.select("file", "off", (F.col("off") + F.col("total")).alias("next"))
    kept = found.join(reachable(chain), ["file", "off"], "left_semi")
    broken = F.when(~F.col("whole"), F.raise_error(F.lit("a record is split between blocks or cut off"))).otherwise(F.col("payload_bytes"))
    return kept.select("page_id", broken.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(typed(pages), path)
    return read_warc(spark, path)
