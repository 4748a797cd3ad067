"""Substring de-duplication by level-wise doubling of repeated windows.

A window is ``window`` consecutive words of one text. Lengths start at a quarter of the window and
double up to it. At the first length only winnowed windows are looked at: those with the least hash
among the ones that fit a full window, so every full window holds one, at the same place in each of
its copies. Windows that are repeated at one length alone are extended to twice that length, to the
left and to the right, of which a full window holds at least one; at the last length every full
window around a survivor is judged. The search ends when the full length is judged or no candidate
survives. A word is removed if a full window that covers it also starts anywhere else.

Copies of a whole text are folded into one before the search, and a task sends one row for a window
it has met twice in a chunk of some megabytes, so a passage that a third of all texts share costs one
row a chunk.

Defined results: a null or blank text has no words and keeps the empty text; texts shorter than a
window lose nothing; null ids stay null; repeated rows count as copies of each other; an empty table
gives an empty result; other columns take no part. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Rolling, aside, bucketed, partitions, restored, row_chunks, stored, text_buffers, word_bounds, word_hashes

WINDOW = 35
_FIRST, _SECOND = Rolling(21), Rolling(22)

#: One window met in a task: its hash (96 bits), how often, and its places in a text when they are
#: still to be judged. Decided rows hold the places of windows that the task itself met twice.
_MET = "h long, g int, n int, decided boolean, key long, more long, at binary"
#: The 128 bits that name a text.
_KEY = ["key", "more"]


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: a quarter, a half, all of ``window``."""
    first = -(-window // 4)
    return [first, min(2 * first, window), window] if window >= 4 else [window]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def winnowed(h: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is least in some run of ``width`` positions that are all ``inside``."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = sliding_min(h, width)
    ends = np.cumsum(np.concatenate([[0], ~inside]))
    whole = ends[width:] == ends[:-width]
    chosen = np.zeros(len(h), bool)
    for shift in range(width):
        chosen[shift : shift + len(least)] |= whole & (h[shift : shift + len(least)] == least)
    return np.flatnonzero(chosen)


def window_hashes(w: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    ends = starts + length
    return _FIRST.ranges(w, starts, ends).view(np.int64), (_SECOND.ranges(w, starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _met_rows(keys: tuple[np.ndarray, np.ndarray], copies: np.ndarray, row_of: np.ndarray, place: np.ndarray, h: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_MET`` for windows of several texts: one for each distinct window, one for each text with decided places."""
    order = np.lexsort((place, row_of, g, h))
    h, g, row_of, place = h[order], g[order], row_of[order], place[order].astype(np.int32)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(h)))
    weight = np.add.reduceat(np.minimum(copies[row_of], 2), head) if len(head) else np.zeros(0, np.int64)
    twice = np.repeat(many > 1, many)
    head_at = pa.array([p.tobytes() if one else None for p, one in zip(place[head], many == 1)], pa.binary())
    out = [h[head], g[head], np.minimum(weight, 2).astype(np.int32), np.zeros(len(head), bool), *[k[row_of[head]] for k in keys]]
    rows, places = row_of[twice], place[twice]
    by = np.lexsort((places, rows))
    rows, places = rows[by], places[by]
    cut = np.flatnonzero(np.diff(rows)) + 1
    groups = np.split(places, cut) if len(rows) else []
    owners = rows[np.concatenate([[0], cut]).astype(np.int64)] if len(rows) else rows
    k = len(owners)
    decided = [keys[0][owners], np.zeros(k, np.int32), np.full(k, 2, np.int32), np.ones(k, bool), *[x[owners] for x in keys]]
    columns = [pa.array(np.concatenate([a, b])) for a, b in zip(out, decided)]
    at = pa.concat_arrays([head_at, pa.array([x.tobytes() for x in groups], pa.binary())])
    return pa.RecordBatch.from_arrays([*columns, at], ["h", "g", "n", "decided", *_KEY, "at"])


def _candidates(texts: DataFrame, window: int, level: int) -> DataFrame:
    """Windows of one level. ``texts``: ``key, more, copies, text`` and, above the first level, ``at``: places that survived the one below."""
    steps = lengths(window)
    length = steps[level]

    def find(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in _KEY]
            copies = batch.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column("at") if level else None
            for low, high in row_chunks(offsets):
                part = data[offsets[low] : offsets[high]]
                starts, ends, counts = word_bounds(part, offsets[low : high + 1] - offsets[low])
                if not len(starts):
                    continue
                w = word_hashes(part, starts, ends)
                row = np.repeat(np.arange(high - low), counts)
                begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
                stop = (begin + counts)[row]
                if level == 0:
                    here = np.arange(len(w))
                    fits = here + length <= stop
                    h = np.full(len(w), np.uint64(0xFFFFFFFFFFFFFFFF))
                    h[fits] = _FIRST.ranges(w, here[fits], here[fits] + length)
                    at = winnowed(h, fits, window - length + 1) if length < window else here[fits]
                else:
                    lists = [np.concatenate([np.frombuffer(x, np.int32) for x in v]) if v else np.zeros(0, np.int32) for v in held.slice(low, high - low).to_pylist()]
                    old = np.concatenate([x.astype(np.int64) + b for x, b in zip(lists, begin)])
                    row_old = np.repeat(np.arange(high - low), [len(x) for x in lists])
                    below = steps[level - 1]
                    wanted = np.zeros(len(w) + 1, np.int64)
                    if level < len(steps) - 1:
                        left = old - (length - below)
                        ok = left >= begin[row_old]
                        wanted[left[ok]] = 1
                        wanted[old] = 1
                        at = np.flatnonzero(wanted)
                    else:  # all full windows around a survivor
                        np.add.at(wanted, np.maximum(old - (length - below), begin[row_old]), 1)
                        np.add.at(wanted, old + 1, -1)
                        at = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                    at = at[at + length <= stop[at]]
                if len(at):
                    h, g = window_hashes(w, at, length)
                    yield _met_rows([k[low:high] for k in keys], copies[low:high], row[at], at - begin[row[at]], h, g)

    return texts.mapInArrow(find, _MET)


def _repeated(met: DataFrame) -> DataFrame:
    """``key, more, at``: places of the windows that occur twice or more anywhere."""
    total = F.sum("n").over(Window.partitionBy("h", "g", "decided"))
    told = met.withColumn("total", total).where("total > 1 and at is not null")
    return told.groupBy(*_KEY).agg(F.collect_list("at").alias("at"))


def folded(docs: DataFrame) -> DataFrame:
    """``key, more, copies, text``: each distinct text once, in buckets of its key that later joins read in place."""
    n = partitions(docs.sparkSession)
    keyed = docs.select(*text_key(), F.coalesce("text", F.lit("")).alias("text"))
    distinct = keyed.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    return bucketed(distinct.repartition(n, *_KEY), n, _KEY, "substrings")


def text_key() -> list[Column]:
    """The first 128 bits of the SHA-256 of a text, in two longs; null and empty are alike."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "key"), (17, "more"))]


def repeated_places(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, more, at``: for each folded text the starts of its windows that occur elsewhere too."""
    found = stored(_repeated(_candidates(texts, window, 0)), "substrings-0")
    for level in range(1, len(lengths(window))):
        if found.isEmpty():
            break
        found = stored(_repeated(_candidates(texts.join(found, _KEY), window, level)), f"substrings-{level}")
    return found


def strip(texts: DataFrame, places: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``key, more, n_words, n_removed, kept_sha256`` (and ``kept_text``) of each folded text."""

    def cut(batches):
        for batch in batches:
            rows = []
            for text, copies, at in zip(batch.column("text"), batch.column("copies"), batch.column("at")):
                words = text.as_py().encode().split()
                n, kept = len(words), words
                if copies.as_py() > 1 and n >= window:
                    kept = []
                elif at.is_valid:
                    delta = np.zeros(n + 1, np.int64)
                    for part in at.as_py():
                        place = np.frombuffer(part, np.int32)
                        np.add.at(delta, place, 1)
                        np.add.at(delta, place + window, -1)
                    kept = list(compress(words, np.cumsum(delta[:-1]) == 0))
                joined = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text and len(kept) < n else None))
            n, gone, sha, kept = map(list, zip(*rows)) if rows else ([], [], [], [])
            made = [*map(batch.column, _KEY), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = [*_KEY, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made, names = [*made, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(made, names)

    schema = "key long, more long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(places, _KEY, "left").mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs``."""
    texts = folded(docs)
    told = strip(texts, repeated_places(texts, window), window)
    ids = docs.select("doc_id", *text_key())
    return ids.join(told, _KEY).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` whose texts lack the repeated words; texts that lose nothing stay as they are.

    Columns of any name and type pass through; an empty table gives an empty result.
    """
    texts = folded(docs)
    told = strip(texts, repeated_places(texts, window), window, with_text=True).where("n_removed > 0").select(*_KEY, "kept_text")
    changed = aside(docs).select("row", "text", *text_key()).join(told, _KEY, "left")
    return changed.withColumn("text", F.coalesce("kept_text", "text")).select(*restored(docs.columns))
