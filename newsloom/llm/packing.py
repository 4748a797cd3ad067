"""Packing: optimal length buckets from the global histogram, token-budget batches in each bucket.

The length of a text is its number of tokens under a tokenizer (``path``), as ``op3`` counts them; only
where none is given it is the number of words. A dynamic programme over the histogram of all lengths
chooses the bucket boundaries with the least padding; each bucket is dealt into batches of
``floor(budget / boundary)`` texts (one at least), so a padded batch stays within the budget unless a
single text exceeds it. The histogram has every distinct length with its count. D distinct lengths take
D * (D - 1) / 2 tokens at least, so T tokens have fewer than 2 * sqrt(T) of them (some ten thousands
for 30 GB); the programme takes time in proportion to D, as its cost is a minimum over lines in order.

Batches are numbered without gathering a bucket: rows are ranked within shards of a bucket, and
shards are offset by the counts of the ones before.

Defined results: a null or blank text has length 0 and is packed like any other; null ids are
packed; ties rank by id and then by a hash of the text; repeated rows are packed each; an empty
table gives an empty result; other columns take no part. Texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import partitions, stored, words_column
from newsloom.llm.tokens import token_counts

BUDGET = 8192
BUCKETS = 12


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """``length, count`` of each distinct length, in order."""
    return sorted((r.n_tokens, r.n) for r in lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())


class Lines:
    """The least of lines ``y = a - c * x`` at growing ``x``; lines come in order of growing ``c``."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int]] = []
        self.at = 0

    def add(self, a: int, c: int, name: int) -> None:
        held = self.held
        while len(held) > 1:
            (a1, c1, _), (a2, c2, _) = held[-2:]
            # the middle line is nowhere below both: it passes the first no sooner than the new one does
            if (a2 - a1) * (c - c1) < (a - a1) * (c2 - c1):
                break
            held.pop()
        held.append((a, c, name))
        self.at = min(self.at, len(held) - 1)

    def least(self, x: int) -> tuple[int, int]:
        held = self.held
        value = lambda i: held[i][0] - held[i][1] * x
        while self.at + 1 < len(held) and value(self.at + 1) < value(self.at):
            self.at += 1
        return value(self.at), held[self.at][2]


def boundaries(lengths: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of lengths, of the least total padding; ties take fewer bounds.

    ``lengths`` are distinct and in order. A last bucket of lengths i to j pads
    ``length[j] * (count up to j - count before i)`` less its tokens; for each j the best i is a
    minimum over lines in ``length[j]``, which grows. Integers, so nothing is rounded.
    """
    if not lengths:
        return []
    m, count, tokens = len(lengths), [0], [0]
    for length, n in lengths:
        count.append(count[-1] + n)
        tokens.append(tokens[-1] + length * n)
    costs = [[lengths[j][0] * count[j + 1] - tokens[j + 1] for j in range(m)]]
    back = [[0] * m]
    for _ in range(1, min(buckets, m)):
        before, lines, cost, at = costs[-1], Lines(), [], []
        for j in range(m):
            lines.add((before[j - 1] if j else 0) + tokens[j], count[j], j)
            least, i = lines.least(lengths[j][0])
            cost.append(least + lengths[j][0] * count[j + 1] - tokens[j + 1])
            at.append(i)
        costs.append(cost)
        back.append(at)
    used = min(range(len(costs)), key=lambda k: costs[k][-1])
    out, j = [], m - 1
    while j >= 0:
        out.append(lengths[j][0])
        j, used = back[used][j] - 1, max(used - 1, 0)
    return out[::-1]


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is not None:
        # the counts carry one column of the rows through, so the id and the hash go as one
        slim = docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text")
        return token_counts(slim, path).select("doc_id.doc_id", "n_tokens", "doc_id.mark")
    return docs.select("doc_id", F.size(words_column(F.col("text"))).cast("long").alias("n_tokens"), F.xxhash64("text").alias("mark"))


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket_len, batch, slot, n_padding``; ``batch`` counts from 0 in each bucket.

    ``path`` is the tokenizer file whose tokens count, in the same place on every machine.
    """
    spark = docs.sparkSession
    lengths = stored(measured(docs, path), "packing")
    bounds = boundaries(histogram(lengths), buckets)
    if not bounds:
        return lengths.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket_len", "batch", "slot", "n_padding")])
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    shards = max(4, partitions(spark))
    dealt = lengths.withColumns({"bucket_len": F.element_at(F.filter(listed, lambda b: b >= F.col("n_tokens")), 1), "shard": F.pmod(F.xxhash64("doc_id", "mark", "n_tokens"), F.lit(shards)).cast("int")})
    sizes = dealt.groupBy("bucket_len", "shard").agg(F.count("*").alias("n"))  # at most buckets x shards rows
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket_len", "shard", earlier.alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "mark"))
    place = (F.col("earlier") + F.col("rank") - 1).cast("long")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1)).cast("long")
    out = dealt.withColumn("rank", rank).join(F.broadcast(offsets), ["bucket_len", "shard"])
    return out.select("doc_id", "n_tokens", "bucket_len", F.floor(place / room).alias("batch"), F.pmod(place, room).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("n_padding"))
