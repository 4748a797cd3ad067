"""Conversation structure repair by aligning turns with the alternating grammar.

``judged`` marks each turn's first fault, ``audits`` finds the cheapest edits of each conversation, ``repaired``
applies them. Edits: ``K``\\ eep costs 0, ``R``\\ erole to user or assistant 1, ``D``\\ elete 2 (the only one for a blank
or repeated turn), ``I``\\ nsert an empty user or assistant turn 5; a truncated turn that stays adds 5. The roles left
are nothing, or user and assistant in turn, ending with assistant, with or without one system turn before them.

The edits are Wagner-Fischer alignments of the turns with target strings ``uaua..`` and ``suaua..`` of each feasible
length. Targets of one kind are suffixes of each other, so one matrix, filled from the last turn back, holds every
length. An incumbent (drop all faults, rerole what does not alternate, mend the end) bounds it: a cell more than
cost/2 deletions or cost/5 insertions off the diagonal cannot be on a best path (Ukkonen's band). Of the lengths
that reach the least cost, each is traced, letters ASCII-least first, and the least audit wins.

A long conversation is aligned ``BLOCK`` turns at a time from its end: what follows a block matters only through the
last role before it, so for each such role the least cost and audit of the rest is kept. Rows are sorted by Spark and
pass through in batches; a task holds one block and the audits of one conversation, never its texts.

Defined results: turns go by ``turn`` (nulls first), ties by role, then by the SHA-256 of the text; repeated rows are
repeated turns. Null roles and texts are one space; an empty role fits no place. Null ids are one conversation. An empty table gives an
empty result; other columns take no part. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import SPACES

FAULTS = ("blank", "duplicate", "truncated")
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLOCK = 256
_LEGAL = frozenset(("su", "ua", "au"))
_FAR = 1 << 60
#: Last role before a place: none yet, system, user, assistant; and what the grammar wants next.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = "uuau"
_ROLE = {"u": "user", "a": "assistant"}


def judged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, mark, fault`` with ``fault`` 0 for none, else 1 + its place in ``FAULTS``.

    ``mark`` is the SHA-256 of the text. One shuffle on the conversation serves this and what follows.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("mark"))
    shown = F.rtrim("text", F.lit(SPACES))
    kind = F.when(shown == "", 1).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "mark").orderBy(F.asc_nulls_first("turn"))) > 1
    # the text goes no further than its marks unless it is asked for
    return rows.withColumn("kind", kind).repartition("conv_id").withColumn("fault", F.when((F.col("kind") != 1) & seen, 2).otherwise(F.col("kind"))).drop("kind")


def _incumbent(block: list[tuple[str, int]], state: int, end: int) -> int:
    """The cost of one way from ``state`` to ``end``: an upper bound."""

    def joined(cost: int, at: int) -> int:
        return cost if at == end else cost + INSERT * (1 + (at in (NONE, SYSTEM) and end == ASSISTANT))

    cost, last, before = 0, 0, None
    for initial, fault in block:
        if fault:
            cost += DELETE
        elif initial == "s" and state == NONE:
            state = SYSTEM
        else:
            before, last = state, initial != _NEXT[state]
            cost += last * REROLE
            state = ASSISTANT if state == USER else USER
    best = joined(cost, state)
    return best if before is None else min(best, joined(cost - last * REROLE + DELETE, before))


class _Matrix:
    """Alignments of a block with the alternating targets that end in one role; cell (i, m) has the least cost of
    turns i on against the last m roles, within a band around the diagonal."""

    def __init__(self, block: list[tuple[str, int]], end: int, most: int):
        self.block, n = block, len(block)
        self.letters = ("a", "u") if end == USER else ("u", "a")  # role m from the end is letters[m % 2]
        above, below = most // INSERT, most // DELETE
        self.low = [max(0, n - i - below) for i in range(n + 1)]
        self.cells: list[list[int]] = [[]] * n + [[INSERT * m for m in range(above + 1)]]
        for i in range(n - 1, -1, -1):
            low, high = self.low[i], n - i + above
            under, shift = self.cells[i + 1], low - self.low[i + 1]
            size, row, left = len(under), [], _FAR
            initial, fault = block[i]
            cost = [_FAR if fault in (1, 2) else (REROLE if initial != x else 0) + CUT * (fault == 3) for x in self.letters]
            for k in range(shift, shift + high - low + 1):
                best = left + INSERT
                if k < size and under[k] + DELETE < best:
                    best = under[k] + DELETE
                if 0 < k <= size and (met := under[k - 1] + cost[(k - shift + low) & 1]) < best:
                    best = met
                row.append(best)
                left = best
            self.cells[i] = row

    def at(self, i: int, m: int) -> int:
        k = m - self.low[i]
        return self.cells[i][k] if 0 <= k < len(self.cells[i]) else _FAR

    def lengths(self, first: str, i: int = 0) -> Iterator[int]:
        """Feasible lengths of targets of turns ``i`` on that begin with ``first``."""
        for m in range(max(1, self.low[i]), self.low[i] + len(self.cells[i])):
            if self.letters[m & 1] == first:
                yield m

    def traced(self, i: int, m: int) -> str:
        """The ASCII-least of the cheapest audits of a cell: D before I before K or R."""
        out, n = [], len(self.block)
        while i < n or m:
            here = self.at(i, m)
            if i < n and here == DELETE + self.at(i + 1, m):
                out.append("D")
                i += 1
            elif m and here == INSERT + self.at(i, m - 1):
                out.append("I")
                m -= 1
            else:
                out.append("K" if self.block[i][0] == self.letters[m & 1] else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def _system_first(block: list[tuple[str, int]]) -> Iterator[tuple[int, int]]:
    """Turns that can stay as the system turn with all before them deleted, and the cost of that."""
    for i, (initial, fault) in enumerate(block):
        if initial == "s" and fault in (0, 3):
            yield i, DELETE * i + CUT * (fault == 3)


def aligned(block: list[tuple[str, int]], after: dict[int, tuple[int, str]], starts: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """The least cost and audit from each state of ``starts`` over ``block`` and then on as ``after`` tells by state."""
    n = len(block)
    gone = (DELETE * n, "D" * n)
    found: dict[int, list] = {q: [] for q in starts}
    for q in starts:
        if q in after:
            found[q].append((gone[0] + after[q][0], lambda q=q: gone[1] + after[q][1]))
    systems = list(_system_first(block)) if NONE in starts else []
    if SYSTEM in after:
        for i, cost in systems:
            found[NONE].append((cost + DELETE * (n - i - 1) + after[SYSTEM][0], lambda i=i: "D" * i + "K" + "D" * (n - i - 1) + after[SYSTEM][1]))
    for end in (USER, ASSISTANT):
        if end not in after:
            continue
        rest, audit = after[end]
        matrix = _Matrix(block, end, max(_incumbent(block, q, end) for q in starts))
        for q in starts:
            for m in matrix.lengths(_NEXT[q]):
                found[q].append((matrix.at(0, m) + rest, lambda m=m, x=matrix, audit=audit: x.traced(0, m) + audit))
        for i, cost in systems:
            for m in matrix.lengths("u", i + 1):
                found[NONE].append((cost + matrix.at(i + 1, m) + rest, lambda i=i, m=m, x=matrix, audit=audit: "D" * i + "K" + x.traced(i + 1, m) + audit))
    out = {}
    for q, ways in found.items():
        least = min((cost for cost, _ in ways), default=_FAR)
        if least < _FAR:
            out[q] = (least, min(audit() for cost, audit in ways if cost == least))
    return out


class _Conversation:
    """What is known of a conversation while its turns come in, the last one first."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.block: list[tuple[str, int]] = []
        self.after = {NONE: (0, ""), ASSISTANT: (0, "")}
        self.counts = [0, 0, 0]
        self.illegal = self.distinct = 0
        self.follows = self.high = self.low = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if len(self.block) == BLOCK:
            self.after = aligned(self.block[::-1], self.after, (NONE, SYSTEM, USER, ASSISTANT))
            self.block = []
        self.block.append((initial, fault))
        if fault:
            self.counts[fault - 1] += 1
        if self.follows is not None and initial + self.follows not in _LEGAL:
            self.illegal += 1
        self.follows = initial
        if turn is not None and turn != self.low:
            self.distinct += 1
            self.high = turn if self.high is None else self.high
            self.low = turn

    def told(self) -> tuple:
        gaps = 0 if self.high is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return (self.conv_id, gaps, *self.counts, self.illegal, *aligned(self.block[::-1], self.after, (NONE,))[NONE])


def _batches(kind: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), kind)], kind.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), kind)], kind.names)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audits(judged_turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation."""
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    slim = judged_turns.select("conv_id", "turn", initial.alias("initial"), "fault", "role", "mark")
    down = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("mark"), F.desc("fault")]
    ordered = slim.sortWithinPartitions("conv_id", *down).select("conv_id", "turn", "initial", "fault")
    longs = ("gaps", *FAULTS, "illegal", "cost")
    out = T.StructType([T.StructField("conv_id", judged_turns.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("audit", T.StringType())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            now = None
            for batch in batches:
                for conv_id, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            yield now.told()
                        now = _Conversation(conv_id)
                    now.add(turn, initial, fault)
            if now is not None:
                yield now.told()

        yield from _batches(_arrow(out), each())

    return ordered.mapInArrow(align, out)


def repaired(turns: DataFrame, told: DataFrame) -> DataFrame:
    """``conv_id, at, role, text, edit``: the turns that stay or come in, those of one conversation in order in one task.

    ``told`` are the audits of ``turns``; each audit is sorted before the turns that it edits.
    """
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.lit(1).alias("second"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("mark"), text.alias("text"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    first = told.select("conv_id", F.lit(0).alias("second"), none("turn"), none("role"), none("mark"), F.col("audit").alias("text"))
    both = first.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "second", F.asc_nulls_first("turn"), "role", "mark").select("conv_id", "second", "role", "text")
    out = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("at", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            audit, place, at, last = "", 0, 0, "-"
            for batch in batches:
                for conv_id, second, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if second:
                        edit, place = audit[place], place + 1
                        if edit != "D":
                            last = role[0] if edit == "K" else "a" if last == "u" else "u"
                            yield conv_id, at, role if edit == "K" else _ROLE[last], text, edit
                            at += 1
                    else:
                        audit, place, at, last = text, 0, 0, "-"
                    while audit.startswith("I", place):
                        last = "a" if last == "u" else "u"
                        yield conv_id, at, _ROLE[last], "", "I"
                        at, place = at + 1, place + 1

        yield from _batches(_arrow(out), each(), 256)

    return both.mapInArrow(apply, out)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``repaired`` turns, as they lie in order in their tasks."""
    out = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            now, mark = None, None
            for batch in batches:
                for conv_id, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if at == 0:
                        if mark is not None:
                            yield now, mark.hexdigest()
                        now, mark = conv_id, hashlib.sha256()
                    mark.update((f"\n{role}:{text}" if at else f"{role}:{text}").encode())
            if mark is not None:
                yield now, mark.hexdigest()

        yield from _batches(_arrow(out), each())

    return turns.select("conv_id", "at", "role", "text").mapInArrow(write, out)
