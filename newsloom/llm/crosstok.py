"""Cross-tokenizer alignment: tokens of a byte-level BPE model (A) against pieces of a SentencePiece model (B).

Both models read a space and the text. A token-byte incidence matrix has a row for each token and a column for each
byte; the row products of A's matrix with the transpose of B's (Gustavson's order: for each token of A, the rows of the
transpose at its bytes, gathered) give the overlap links and how many bytes each covers. Byte offsets where tokens of both end
cut a text into groups; the product of A's token-group incidence with the transpose of B's has an entry for each two
tokens of a group. Only its row sizes are needed, so that product stops at its symbolic phase, and a group of any size
costs no more than its tokens.

Neither model joins a character with the white space after it (B's vocabulary is checked for it), so a text is cut before
blanks and line ends that follow other characters, and each such unit is encoded once in a worker. A chunk of texts sends
one row for each distinct pair of ids that it links, with its number of links; pairs are summed and compared over the
corpus by relation and their answers come back to the chunk, which never moves: it lies in a table bucketed by chunk.

Defined results: null and empty texts, and those whose tokens of A or B do not spell the text, have no tokens and zeros;
null ids stay null; repeated rows give repeated results and each counts in the corpus; an empty table gives an empty
result; other columns take no part. Texts are read whole. Of pairs that tie for the highest count of a B id all are best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import bucketed, partitions, row_chunks, text_buffers
from newsloom.llm.lm import packed, unpacked
from newsloom.llm.pieces import MARK, Model, joined
from newsloom.llm.tokens import _WS, PRE_TOKEN, byte_alphabet, merge_ranks

CHUNK = 8 << 20
#: Units that a worker remembers, and characters of them, before it starts anew.
REMEMBERED, CHARACTERS = 1 << 18, 1 << 23
#: Units that are encoded and aligned at once.
TOGETHER = 1 << 15
#: White space with what follows it, going on over white space other than blanks and line ends.
UNIT = re.compile(f"[{_WS}]*[^{_WS}]+(?:(?![ \\n])[{_WS}]+[^{_WS}]+)*|[{_WS}]+")


@dataclass
class Incidence:
    """A sparse 0/1 matrix by rows: row ``i`` has ones in the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    @classmethod
    def of_bytes(cls, sizes: np.ndarray) -> Incidence:
        """Tokens that lie one after the other: each has the next ``size`` bytes."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return cls(starts, np.arange(starts[-1]))

    @classmethod
    def of_groups(cls, ends: np.ndarray, cuts: np.ndarray) -> Incidence:
        """Tokens that end at ``ends``: each is in the group that the next cut ends."""
        return cls(np.arange(len(ends) + 1), np.searchsorted(cuts, ends))

    def transposed(self, width: int) -> Incidence:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Incidence(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=width))]), rows[order])

    def product(self, other: Incidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the entries of ``self @ other``, by rows: for each one in a row of ``self``, the row of
        ``other`` that it names, equal columns of a row added up."""
        size = np.diff(other.starts)[self.columns]
        rows = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), size)
        first = np.cumsum(size) - size
        met = other.columns[np.arange(size.sum()) + np.repeat(other.starts[self.columns] - first, size)]
        if len(met) and np.any((np.diff(rows) == 0) & (np.diff(met) < 0)):
            order = np.lexsort((met, rows))
            rows, met = rows[order], met[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 0) | (np.diff(met) != 0)])[: len(met)])
        return rows[new], met[new], np.diff(np.append(new, len(met)))

    def row_sizes(self, other: Incidence) -> np.ndarray:
        """The symbolic phase of the product where a row of ``self`` names one row of ``other``: entries in each row."""
        return np.diff(other.starts)[self.columns]


class ByteLevel:
    """Ids of strings under the byte-level model, and the bytes of each id."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        of = byte_alphabet()
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if set(piece) <= set(of):
                self.spelled[i] = bytes(of[c] for c in piece)
        if ranks is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            library.encode_special_tokens = True
            self.encode = lambda x: library.encode(x, add_special_tokens=False).ids
            return
        import tiktoken

        cut, known = regex.compile(PRE_TOKEN), {x: i for i, x in enumerate(self.spelled) if x}
        ids = [known[x] for x in ranks]
        merging = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

        def encode(unit: str) -> list[int]:
            out = []
            for x in cut.findall(unit):
                out += [ids[r] for r in merging.encode_ordinary(x)]
            return out

        self.encode = encode


class Pieces:
    """Ids of units under the SentencePiece model, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.spelled = Model(path).spelled  # raises where a piece crosses units
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # after a line end, which is in no longer piece, the library adds nothing before a unit
        self.lead = len(self.library.encode("\n"))

    def encode(self, units: list[str]) -> list[list[int]]:
        return [ids[self.lead :] for ids in self.library.encode(["\n" + x for x in units], num_threads=1)]


class Units(dict):
    """Numbers of units, with what both models make of each; one for each worker process."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in m.spelled], np.int64) for m in (a, b)]
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.held = 0
        self.groups: list[str] = []
        self.counts = np.zeros((6, 0), np.int64)  # tokens of A and B, groups, links, pairs within groups, and 1 where the bytes differ
        self.pairs = np.zeros(0, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n

    def make_room(self) -> None:
        if len(self) > REMEMBERED or self.held > CHARACTERS:
            self._forget()

    def learn(self) -> None:
        """Encode and align the units met since the last call."""
        for low in range(0, len(self.new), TOGETHER):
            self._learn(self.new[low : low + TOGETHER])
        self.held += sum(map(len, self.new))
        self.new = []

    def _learn(self, units: list[str]) -> None:
        """Encode and align ``units``, all of them in one product."""
        ids, sizes, n, wrong = [], [], [], np.zeros(len(units), np.int64)
        whole = [x.encode() for x in units]
        # texts that hold the mark itself are spelled with blanks in their place
        for spelled, size, told in zip((self.a.spelled, self.b.spelled), self.sizes, ([self.a.encode(x) for x in units], self.b.encode(units))):
            wrong |= np.fromiter((b"".join(map(spelled.__getitem__, x)) != w for x, w in zip(told, whole)), bool, len(whole))
            told = [x if not bad else [] for x, bad in zip(told, wrong)]
            n.append(np.fromiter(map(len, told), np.int64, len(told)))
            ids.append(np.fromiter((i for x in told for i in x), np.int64, int(n[-1].sum())))
        if wrong.any():  # what the second model misspells has no tokens in the first either
            keep = np.repeat(wrong == 0, n[0])
            ids[0], n[0] = ids[0][keep], np.where(wrong == 0, n[0], 0)
        sizes = [size[x] for size, x in zip(self.sizes, ids)]
        a, b = Incidence.of_bytes(sizes[0]), Incidence.of_bytes(sizes[1])
        rows, columns, _ = a.product(b.transposed(int(b.starts[-1])))
        cuts = np.intersect1d(a.starts[1:], b.starts[1:], assume_unique=True)
        of_a, of_b = Incidence.of_groups(a.starts[1:], cuts), Incidence.of_groups(b.starts[1:], cuts)
        together = of_a.row_sizes(of_b.transposed(len(cuts)))

        first = np.concatenate([[0], np.cumsum(n[0])])
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])  # noqa: E731 - per token of A to per unit
        links = summed(np.bincount(rows, minlength=len(ids[0])))
        ends = np.concatenate([[0], a.starts[1:]])[first]  # the byte where each unit ends
        n_groups = np.diff(np.searchsorted(cuts, ends, side="right"))
        self.counts = np.hstack([self.counts, np.stack([n[0], n[1], n_groups, links, summed(together), wrong])])
        self.pairs = np.concatenate([self.pairs, ids[0][rows] << 32 | ids[1][columns]])
        self._write(ids, of_a, of_b, n_groups)

    def _write(self, ids: list[np.ndarray], of_a: Incidence, of_b: Incidence, n_groups: np.ndarray) -> None:
        """The groups of each unit as text."""
        sides = []
        for x, of in zip(ids, (of_a, of_b)):
            words, at = list(map(str, x.tolist())), np.searchsorted(of.columns, np.arange(int(n_groups.sum()) + 1)).tolist()
            sides.append([",".join(words[i:j]) if j - i > 1 else words[i] for i, j in zip(at, at[1:])])
        each, at = [f"{x}|{y}" for x, y in zip(*sides)], np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.groups += [";".join(each[i:j]) for i, j in zip(at, at[1:])]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` with ``n_a, n_b, n_groups, n_links, n_group_links, groups_sha256`` and,
    from the counts of linked id pairs over all rows, ``n_best`` and ``count_sum``.

    The files lie in the same place on every machine; what is broadcast is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(merge_ranks(path_a))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    own = T.StructType([T.StructField("kept", kept.schema["kept"].dataType), *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, units = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            units = units or Units(ByteLevel(path_a, ranks.value), Pieces(path_b))
            _, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets, CHUNK):
                units.make_room()
                codes, n = array("i"), []
                for text in batch.column("text").slice(low, high - low):
                    found = UNIT.findall(" " + text.as_py()) if text.is_valid and len(text.as_py()) else []
                    codes.extend(map(units.__getitem__, found))
                    n.append(len(found))
                units.learn()
                codes, n = np.asarray(codes, np.int64), np.asarray(n, np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                bad = np.diff(np.concatenate([[0], np.cumsum(units.counts[5][codes])])[bounds]) > 0
                codes, n = codes[np.repeat(~bad, n)], np.where(bad, 0, n)
                bounds = np.concatenate([[0], np.cumsum(n)])
                totals = [np.diff(np.concatenate([[0], np.cumsum(x[codes])])[bounds]) for x in units.counts[:5]]
                marks, groups = [], units.groups
                for at, to in zip(bounds.tolist(), bounds[1:].tolist()):
                    marks.append(hashlib.sha256(";".join([groups[c] for c in codes[at:to].tolist()]).encode()).hexdigest() if to > at else "")
                used, codes, times = np.unique(codes, return_inverse=True, return_counts=True)
                flat, links = joined(units.pairs, units.counts[3], used)
                pairs, places = np.unique(flat, return_inverse=True)
                linked = np.bincount(places, np.repeat(times, links), len(pairs)).astype(np.int64)
                rows = pa.StructArray.from_arrays([batch.column("kept").slice(low, high - low), *[pa.array(x, pa.int64()) for x in totals], pa.array(marks, pa.string())], own.fieldNames())
                held = [packed(x) for x in (n, codes, links, places)]
                one = [[chunk], [pairs], [linked], [held]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(one, kinds)], pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), rows)], ["chunk", "pairs", "linked", "places", "rows"])
                chunk += 1

    longs = T.ArrayType(T.LongType())
    shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("pairs", longs), T.StructField("linked", longs), T.StructField("places", T.ArrayType(T.BinaryType())), T.StructField("rows", T.ArrayType(own))])
    chunks = bucketed(kept.mapInArrow(encode, shape), partitions(spark), ["chunk"], "crosstok_chunks")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "linked")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.linked").alias("linked"))
    # a B id has at most as many partners as A's vocabulary has ids
    counted = asked.groupBy("pair").agg(F.sum("linked").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    told = counted.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))
    answers = asked.select("chunk", "at", "pair").join(told, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")
    out = T.StructType([*own["kept"].dataType.fields, *own.fields[1:], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def assemble(key, held: pa.Table, told: pa.Table) -> pa.Table:
        n, codes, links, places = (unpacked(x.as_py()).astype(np.int64) for x in held.column("places")[0])
        order = np.argsort(told.column("at").to_numpy())
        unit_ends, row_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (links, n))
        sums = []
        for of_pair in (told.column("best").to_numpy().astype(np.int64), told.column("count").to_numpy()):
            of_unit = np.diff(np.concatenate([[0], np.cumsum(of_pair[order][places])])[unit_ends])
            sums.append(np.diff(np.concatenate([[0], np.cumsum(of_unit[codes])])[row_ends]))
        rows = held.column("rows").combine_chunks().flatten()
        first, *rest = rows.flatten()
        return pa.table([*first.flatten(), *rest, *[pa.array(x, pa.int64()) for x in sums]], out.fieldNames())

    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(assemble, out)
