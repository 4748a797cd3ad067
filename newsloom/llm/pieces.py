"""SentencePiece encoding and decoding as relations, for models with byte fallback.

A text becomes units: a run of word marks with what follows it. Each task numbers the units of a chunk
of texts; the ``HOT`` most frequent ones (told from a sample of rows, which decides only where a unit
is looked up) come from a dictionary of that size. Every other one is cut where two characters meet that
are side by side in no piece, which no piece can span, and each part is sent once a chunk. Distinct parts
meet their pieces by relation: substrings of bounded length are exploded, equi-joined to the piece
table, and the edges of a part, each packed in one long, are grouped and folded with ``aggregate``.
Where the cuts fall comes back to the chunk, which never moves: it lies in a table bucketed by chunk.

Two folds read the same lattice. ``viterbi`` keeps the best sum of scores and a back pointer for every
place; it is what the library does for a unigram model. ``merged`` takes edges from the best score
down and merges the two neighbours that an edge spans: any two pieces that meet inside a unit were
formed by better edges, so this is what the library does for a BPE model. Pieces of marks alone all
have one score, the least, and the library's leftmost rule then takes the longest of them from the
left. Characters in no piece become bytes.

Defined results: a null or empty text has no pieces; null ids stay null; repeated rows give repeated
results; an empty table gives an empty result; other columns take no part. Texts are read whole, and a
unit may have any length. Of edges with equal scores the leftmost merges first.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import bucketed, partitions, row_chunks, stored, text_buffers
from newsloom.llm.lm import packed, unpacked

MARK = "▁"
#: White space that is in no piece of several characters stands alone (the table is checked for it).
ALONE = r"\t\n\x0b\f"
UNITS = re.compile(f"[{ALONE}]|{MARK}{{16}}(?={MARK})|{MARK}*[^{MARK}{ALONE}]+|{MARK}+")
_UNUSUAL = re.compile(f"[{MARK}\\t\\x0b\\f]")
HOT = 1 << 18
#: Rows that the hot units are told from.
SAMPLE = 1 << 14
CHUNK = 8 << 20
#: Rows that are spelled at once.
_ROWS = 1 << 8
#: Bits of an edge: its length (of marks alone: how much it lacks to the most), and below its rank its start.
_LENGTH, _START = 7, 26
_MOST = (1 << _LENGTH) - 1


class Model:
    """What the library tells of a model file; as large as its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)
        self.pieces = [(library.id_to_piece(i), i, float(library.get_score(i))) for i in range(library.vocab_size()) if not special(i)]
        if any(len(p) > 1 and (MARK in p.lstrip(MARK) or any(c in p for c in "\t\n\x0b\f")) for p, _, _ in self.pieces):
            raise ValueError("a piece of this model crosses units")
        self.first_byte = library.piece_to_id("<0x00>")
        self.ids = {p: i for p, i, _ in self.pieces}
        self.side_by_side = frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))
        self.spelled = [b""] * library.vocab_size()
        for p, i, _ in self.pieces:
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b in range(256):
            self.spelled[self.first_byte + b] = bytes([b])

    def parts(self, unit: str) -> list[str]:
        """The unit, cut wherever no piece can span; words of letters alone, which hardly have such a place, stay whole."""
        if unit.isalpha() or unit[1:].isalpha():
            return [unit]
        out, at = [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in self.side_by_side:
                out.append(unit[at:i])
                at = i
        return [*out, unit[at:]]

    def cut(self, unit: str, lengths: str | None) -> list[int]:
        """The ids of a unit whose pieces have these lengths (a character each); None: one each."""
        known, out, at = self.ids, [], 0
        for end in accumulate(map(ord, lengths)) if lengths is not None else range(1, len(unit) + 1):
            piece = unit[at:end]
            at = end
            if (i := known.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.first_byte + b for b in piece.encode()]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, score, rank, marks``; pieces of equal score have equal ranks."""
        scores = sorted({s for _, _, s in self.pieces}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        return spark.createDataFrame([(p, s, rank[s], not p.strip(MARK)) for p, _, s in self.pieces], "piece string, score double, rank long, marks boolean")


def units_in(text: str | None) -> list[str]:
    """The units of a text, in order; joined they are the text with marks for spaces and one before it."""
    if not text:
        return []
    if text[0] == " " or "  " in text or _UNUSUAL.search(text):
        return UNITS.findall(MARK + text.replace(" ", MARK))
    first, *lines = text.split("\n")
    out = [MARK + w for w in first.split(" ")]
    for line in lines:
        start, *words = line.split(" ")
        out += ["\n", start] if start else ["\n"]
        out += [MARK + w for w in words]
    return out


def met_pieces(units: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """``unit, s, n`` and the piece's columns for each substring of ``least`` characters or more that is a piece.

    Lengths are tried as far as some piece goes that begins with the same three characters.
    """
    longest = pieces.where(F.length("piece") > 2).groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(F.length("piece")).alias("most"))
    # outer, as a filter on units would reach below their grouping and keep its shuffle from being shared
    every = F.when(F.length("unit") >= least, F.sequence(F.lit(1), F.length("unit") - least + 1))
    starts = units.select("unit", F.explode_outer(every).alias("s"))
    headed = starts.withColumn("head", F.substring("unit", F.col("s"), F.lit(3))).join(F.broadcast(longest), "head", "left")  # both tables are as small as the vocabulary
    last = F.least(F.greatest(F.coalesce("most", F.lit(2)), F.lit(2)), F.length("unit") - F.col("s") + 1)
    spans = headed.select("unit", "s", F.explode(F.sequence(F.lit(least), last)).alias("n"))
    return spans.withColumn("piece", F.substring("unit", F.col("s"), F.col("n"))).join(F.broadcast(pieces), "piece")


def merged(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """``unit, lengths`` of the distinct ``unit`` that hold a piece of several characters, by merging from the best score down."""
    code = F.when(F.col("marks"), _MOST - F.col("n")).otherwise(F.col("n"))
    edge = F.shiftleft("rank", _START + _LENGTH).bitwiseOR(F.shiftleft((F.col("s") - 1).cast("long"), _LENGTH)).bitwiseOR(code.cast("long"))
    marks = F.max(F.when(F.col("marks"), F.col("rank")))
    edges = met_pieces(units, pieces, 2).groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"), marks.alias("marks"))

    def start(e: Column) -> Column:
        return F.shiftright(e, _LENGTH).bitwiseAND(F.lit((1 << _START) - 1)).cast("int")

    def step(b: Column, e: Column) -> Column:
        is_marks = F.shiftright(e, _START + _LENGTH) == F.col("marks")
        code = e.bitwiseAND(F.lit(_MOST)).cast("int")
        at = F.array_position(b, start(e)).cast("int")  # counts from 1, so this is the place of the bound after it
        pair = F.when((at > 0) & (F.get(b, at + 1) == start(e) + code), F.array_remove(b, F.get(b, at))).otherwise(b)
        end = start(e) + F.lit(_MOST) - code
        run = F.when((at > 0) & F.array_contains(b, end), F.filter(b, lambda x: (x <= start(e)) | (x >= end))).otherwise(b)
        return F.when(F.coalesce(is_marks, F.lit(False)), run).otherwise(pair)

    bounds = F.aggregate("edges", F.sequence(F.lit(0), F.length("unit")), step)
    return edges.select("unit", bounds.alias("b")).select("unit", _lengths(F.col("b")))


def viterbi(units: DataFrame, pieces: DataFrame, unknown: float | None = None) -> DataFrame:
    """``unit, lengths`` of each distinct ``unit``: the pieces with the greatest sum of scores; of equal sums the longest last piece.

    A character in no piece costs ``unknown`` (the least score less ten, as in the library).
    """
    if unknown is None:
        unknown = pieces.agg(F.min("score")).first()[0] - 10.0
    own = pieces.select("piece", "score")
    met = met_pieces(units, own, 1).select("unit", F.struct((F.col("s") + F.col("n") - 1).alias("end"), (F.col("s") - 1).alias("start"), "score").alias("e"))
    edges = units.join(met.groupBy("unit").agg(F.collect_list("e").alias("edges")), "unit", "left")
    none = F.array().cast("array<struct<end:int,start:int,score:double>>")

    def place(best: Column, end: Column) -> Column:
        # state: for each place the best sum and, from it, the place before
        reach = F.transform(F.filter("edges", lambda e: e.end == end), lambda e: F.struct((F.get(best, e.start).total + e.score).alias("total"), (-e.start).alias("back")))
        alone = F.struct((F.get(best, end - 1).total + F.lit(unknown)).alias("total"), (F.lit(1) - end).alias("back"))
        single = F.exists("edges", lambda e: (e.end == end) & (e.start == end - 1))
        return F.concat(best, F.array(F.array_max(F.when(single, reach).otherwise(F.concat(reach, F.array(alone))))))

    first = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("back")))
    held = edges.select("unit", F.coalesce("edges", none).alias("edges"))
    states = held.where(F.length("unit") > 0).withColumn("best", F.aggregate(F.sequence(F.lit(1), F.length("unit")), first, place))
    # back from the end: each step adds the place before the lowest bound known
    back = F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.array(F.length("unit")), lambda b, _: F.when(F.get(b, F.lit(0)) > 0, F.concat(F.array(-F.get(F.col("best"), F.get(b, F.lit(0))).back), b)).otherwise(b))
    return states.select("unit", back.alias("b")).select("unit", _lengths(F.col("b")))


def _lengths(bounds: Column) -> Column:
    """Bounds as a string with a character for each length."""
    inner = F.size(bounds) - 1
    return F.array_join(F.zip_with(F.slice(bounds, 1, inner), F.slice(bounds, 2, inner), lambda a, z: F.char(z - a)), "").alias("lengths")


_FOLDS = {"merge": merged, "viterbi": viterbi}


class Numbering(dict):
    """Numbers of strings: those of the dictionary it starts from, then those met first here."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


def joined(flat: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``codes`` of ``flat`` (a run of each ``size``) one after the other, and their sizes."""
    first, n = np.cumsum(size) - size, size[codes]
    total = np.cumsum(n)
    step = np.repeat((first[codes] - (total - n)).astype(np.int32), n)
    return flat[step + np.arange(len(step), dtype=np.int32)], n


def hot_units(docs: DataFrame, pieces: DataFrame, fold: str, hot: int) -> list[tuple[str, str | None]]:
    """Frequent units with the lengths of their pieces, the most frequent first; at most ``hot``."""
    rows = docs.count()
    if not rows:
        return []

    def split(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(units_in(text.as_py()), pa.string())], ["unit"])

    some = docs.sample(min(1.0, SAMPLE / rows), seed=7).select("text").mapInArrow(split, "unit string")
    top = stored(some.groupBy("unit").count().orderBy(F.desc("count"), "unit").limit(hot), "pieces-hot")
    known = top.join(_FOLDS[fold](top.select("unit"), pieces), "unit", "left")
    return [(r.unit, r.lengths) for r in sorted(known.collect(), key=lambda r: (-r["count"], r.unit))]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), fold: str = "merge", hot: int = HOT) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``ids``, the pieces of each text in order.

    ``fold`` is how the model chooses: ``merge`` for BPE, ``viterbi`` for unigram models.
    """
    spark, model = docs.sparkSession, Model(path)
    pieces = model.table(spark)
    common = hot_units(docs, pieces, fold, hot)
    spelled = [model.cut(u, n) for u, n in common]
    ends = np.cumsum([0, *map(len, spelled)])
    shared = spark.sparkContext.broadcast(({u: i for i, (u, _) in enumerate(common)}, np.array([i for ids in spelled for i in ids], np.int32), ends))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text")
    kind = kept.schema["kept"].dataType

    def cut(batches: Iterator[pa.RecordBatch]):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets, CHUNK):
                units, counts, codes = Numbering(shared.value[0]), [], array("i")
                for text in batch.column("text").slice(low, high - low):
                    found = units_in(text.as_py())
                    counts.append(len(found))
                    codes.extend(map(units.__getitem__, found))
                parts, n_parts, of_units = Numbering(shared.value[0]), [], array("i")
                for unit in units.new:
                    found = model.parts(unit)
                    n_parts.append(len(found))
                    of_units.extend(map(parts.__getitem__, found))
                places = [packed(np.asarray(x, np.int64)) for x in (counts, codes, n_parts, of_units)]
                rows = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column("kept").slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([parts.new], pa.list_(pa.string())), pa.array([places], pa.list_(pa.binary())), rows], ["chunk", "rare", "places", "rows"])
                chunk += 1

    shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.BinaryType())), T.StructField("rows", T.ArrayType(kind))])
    chunks = bucketed(kept.mapInArrow(cut, shape), partitions(spark), ["chunk"], "pieces_chunks")
    asked = chunks.select("chunk", F.posexplode("rare").alias("at", "unit")).where("unit is not null").repartition(partitions(spark), "unit")
    # all columns take part in the grouping, so that it and the join below read one shuffle
    units = asked.groupBy("unit").agg(F.min("chunk").alias("chunk"), F.min("at").alias("at")).where("chunk is not null and at is not null")
    known = _FOLDS[fold](units.select("unit"), pieces)
    answers = asked.join(known, "unit", "left").select(F.col("chunk").alias("of"), "at", "lengths")

    def assemble(key, held: pa.Table, told: pa.Table) -> pa.Table:
        _, ids, ends = shared.value
        rare = held.column("rare").combine_chunks().flatten()
        lengths = pa.nulls(len(rare), pa.string())
        if told.num_rows:
            lengths = told.column("lengths").take(pa.array(np.argsort(told.column("at").to_numpy())))
        own, size = array("i"), []
        for low in range(0, len(rare), 1 << 16):
            for unit, n in zip(rare.slice(low, 1 << 16).to_pylist(), lengths.slice(low, 1 << 16).to_pylist()):
                found = model.cut(unit, n)
                own.extend(found)
                size.append(len(found))
        counts, codes, n_parts, of_units = (unpacked(x.as_py()).astype(np.int32) for x in held.column("places")[0])
        # a rare unit is a run of parts, and a text a run of units
        values, n = joined(np.concatenate([ids, np.asarray(own, np.int32)]), np.concatenate([np.diff(ends), np.asarray(size, np.int64)]), of_units)
        each = np.add.reduceat(n, np.cumsum(n_parts) - n_parts) if len(n_parts) else np.zeros(0, np.int64)
        values, n = joined(np.concatenate([ids, values]), np.concatenate([np.diff(ends), each]), codes)
        offsets = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        rows = held.column("rows").combine_chunks().flatten()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        return pa.table([*rows.flatten(), lists], [*keep, "ids"])

    out = T.StructType([*kind.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(assemble, out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` spell; null ids give the empty text."""
    spelled = Model(path).spelled
    flat, size = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def spell(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held, texts = batch.column("ids"), []
            for low in range(0, len(held), _ROWS):
                some = held.slice(low, _ROWS)
                data, n = joined(flat, size, some.flatten().to_numpy())
                # the bytes of each row end where its last piece does; null rows have no pieces
                ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(some), 0).to_numpy())
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])].tolist()
                data = data.tobytes()
                texts += [data[a:z].removeprefix(b" ").decode("utf-8", "replace") for a, z in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(spell, out)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_sha256, round_trip``: digests of what encoding and then decoding gives."""
    first = Model(path).first_byte
    marked = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"))
    back = decode(encode(marked, path, ("doc_id", "mark")), path)
    of_bytes = F.size(F.filter("ids", lambda i: (i >= first) & (i < first + 256))).cast("long")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), of_bytes.alias("n_byte_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("mark")).alias("round_trip"))
