"""LM scoring: cross-entropy difference of two matched n-gram models.

A target model (documents labelled as good) and a background model (all other documents) share one
vocabulary, order and smoothing. Every word and every pair of words of the corpus is counted under its
own 64-bit hash, so the models grow with the corpus. The probability of a word after another
interpolates the pair's share with the word's add-one share over the vocabulary of all documents.
A document's score is the mean over its words of ``loss(target) - loss(background)``: lower is nearer
the target.

The models stay in tables, dealt over buckets of hashes; no task or driver holds a whole one. Texts
are cut into chunks of rows; a chunk sends to each bucket the counts of its distinct words and pairs,
in order of their hashes, and gets back what all chunks together counted, in the same order. The
chunks themselves are never shuffled: they lie in a table bucketed by chunk, which the labels and the
counts come to.

Defined results: a null or blank text has no words and null losses and score; null ids stay null and
match no label; labels that repeat for a document count once, the best one; repeated documents count
each time; an empty table gives an empty result; a model without documents is uniform; other columns
take no part. Texts are read whole; sums run in word order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bucketed, mixed, partitions, row_chunks, stored, text_buffers, word_bounds, word_hashes

PAIR_WEIGHT = 0.6
#: Bytes of text for each bucket of hashes, so that a bucket stays the same size as the corpus grows.
BUCKET_BYTES = 32 << 20
#: Bytes of text in a chunk: words and pairs that repeat in a chunk are sent once.
CHUNK = 16 << 20


def packed(x: np.ndarray) -> bytes:
    """Numbers of at least 0 in the smallest type that holds them, compressed byte plane by byte plane."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return kind.char.encode() + zlib.compress(planes.tobytes(), 1)


def unpacked(held: bytes) -> np.ndarray:
    kind = np.dtype(held[:1].decode())
    planes = np.frombuffer(zlib.decompress(held[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pair_hashes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with the one before, and where there is one before in the same row."""
    inside = np.ones(len(h), bool)
    inside[np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]] = False
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        return mixed(h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at]), at


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start in keys in order, and the end; a bucket is a range of hashes."""
    lows = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, lows), len(keys))


def keyed(places: list[bytes]) -> tuple:
    """From a chunk: words of each row; its distinct words and pairs, in order; the place of each word, and
    of the pairs' second words; the place of each pair."""
    counts, one, steps = map(unpacked, places)
    counts, own = counts.astype(np.int64), np.cumsum(steps, dtype=np.uint64)
    both, at = pair_hashes(own[one], counts)
    two, place = np.unique(both, return_inverse=True)
    return counts, own, two, one.astype(np.int64), at, place


def chunked(docs: DataFrame, kind: str) -> DataFrame:
    """``chunk, places, ids``: the ids of a chunk of rows, and packed the words of each row, the place of
    each word among the chunk's distinct ones, and these."""

    def cut(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets, CHUNK):
                part = data[offsets[low] : offsets[high]]
                starts, ends, counts = word_bounds(part, offsets[low : high + 1] - offsets[low])
                own, place = np.unique(word_hashes(part, starts, ends), return_inverse=True)
                # steps between keys in order take fewer bytes than keys
                places = [packed(counts), packed(place), packed(np.diff(own, prepend=np.uint64(0)))]
                ids = batch.column("doc_id").slice(low, high - low).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([places], pa.list_(pa.binary())), pa.array([ids], pa.list_(batch.schema.field("doc_id").type))],
                    ["chunk", "places", "ids"],
                )
                chunk += 1

    return docs.select("doc_id", "text").mapInArrow(cut, f"chunk long, places array<binary>, ids array<{kind}>")


def sent(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, counts``: for each bucket the chunk's keys there and their counts in both models, of words and of pairs."""

    def cut(batches):
        for batch in batches:
            for chunk, places, good in zip(*(batch.column(n) for n in ("chunk", "places", "good"))):
                counts, own, two, one, at, place = keyed(places.as_py())
                target = np.zeros(len(counts), bool)
                target[good.as_py() or []] = True
                mine = np.repeat(target, counts)
                rows, has = [[] for _ in range(buckets)], set()
                for keys, where, told in ((own, one, mine), (two, place, mine[at])):
                    first = np.bincount(where, weights=told, minlength=len(keys)).astype(np.int64)
                    n = np.bincount(where, minlength=len(keys))
                    limits = edges(keys, buckets)
                    has.update(np.flatnonzero(np.diff(limits)).tolist())
                    for b in range(buckets):
                        x, y = limits[b], limits[b + 1]
                        rows[b] += [packed(np.diff(keys[x:y], prepend=np.uint64(0))), packed(first[x:y]), packed((n - first)[x:y])]
                has = sorted(has)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()] * len(has), pa.int64()), pa.array(has, pa.int32()), pa.array([rows[b] for b in has], pa.list_(pa.binary()))],
                    ["chunk", "bucket", "counts"],
                )

    return chunks.mapInArrow(cut, "chunk long, bucket int, counts array<binary>")


_TOTALS = "chunk long, bucket int, counts array<binary>, vocabulary long, n_target long, n_background long"


def add_up(table: pa.Table) -> pa.Table:
    """The rows of a bucket with the sums over all chunks; the first row also has the bucket's own sums."""
    held = [[unpacked(x) for x in row] for row in table.column("counts").to_pylist()]
    made, sums = [[] for _ in held], []
    for low in (0, 3):
        keys = [np.cumsum(row[low], dtype=np.uint64) for row in held]
        own, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(place, weights=np.concatenate([row[low + m] for row in held]), minlength=len(own)).astype(np.int64) for m in (1, 2)]
        sums.append((len(own), *[int(t.sum()) for t in totals]))
        at = 0
        for row, k in zip(made, keys):
            row += [packed(t[place[at : at + len(k)]]) for t in totals]
            at += len(k)
    ones = [[x, *[0] * (len(held) - 1)] for x in sums[0]]
    return pa.table(
        [table.column("chunk"), table.column("bucket"), pa.array(made, pa.list_(pa.binary())), *[pa.array(x, pa.int64()) for x in ones]],
        ["chunk", "bucket", "counts", "vocabulary", "n_target", "n_background"],
    )


def losses(unigram: np.ndarray, pair: np.ndarray, one: np.ndarray, at: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """Loss of each word, from the counts of its word and, for the words ``at``, of the pair with the word before."""
    p = (unigram[one] + 1.0) / (total + vocabulary)
    before = unigram[one[at - 1]]
    joint = pair / np.maximum(before, 1)
    out = p.copy()
    out[at] = np.where(before > 0, PAIR_WEIGHT * joint + (1 - PAIR_WEIGHT) * p[at], p[at])
    return -np.log(out)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of each document."""
    spark = docs.sparkSession
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1 and doc_id is not null").select("doc_id")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = size // BUCKET_BYTES + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = bucketed(chunked(docs, kind), partitions(spark), ["chunk"], "lm_chunks")
    # never by broadcast: labels grow with the documents
    at = chunks.select("chunk", F.posexplode("ids").alias("pos", "doc_id")).join(good.hint("merge"), "doc_id")
    told = chunks.join(at.groupBy("chunk").agg(F.collect_list("pos").alias("good")).hint("merge"), "chunk", "left")
    totals = stored(sent(told.select("chunk", "places", "good"), buckets).groupBy("bucket").applyInArrow(add_up, _TOTALS), "lm-totals")
    whole = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "n_target", "n_background")]).first()
    vocabulary, n_each = whole.vocabulary, (whole.n_target, whole.n_background)

    def judge(key, table: pa.Table, counted: pa.Table) -> pa.Table:
        counts, _, _, one, at, place = keyed(table.column("places")[0].as_py())
        held, bucket = counted.column("counts"), counted.column("bucket").to_pylist()
        parts = [[unpacked(x) for x in held[i].as_py()] for _, i in sorted((b, i) for i, b in enumerate(bucket))]
        joined = [np.concatenate([p[k] for p in parts]).astype(np.float64) if parts else np.zeros(0) for k in range(4)]
        first = np.concatenate([[0], np.cumsum(counts)])
        full, mean = np.flatnonzero(counts), []
        for m in (0, 1):
            total = np.zeros(len(counts))
            if len(full):
                total[full] = np.add.reduceat(losses(joined[m], joined[2 + m][place], one, at, n_each[m], vocabulary), first[full])
            mean.append(total / np.maximum(counts, 1))
        ids = table.column("ids").combine_chunks().slice(0, 1).flatten()
        columns = [pa.array(x, pa.float64(), mask=counts == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.table([ids, pa.array(counts, pa.int64()), *columns], ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    back = totals.select("chunk", "bucket", "counts")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(judge, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")
