"""Token counts of whole texts under a byte-level BPE tokenizer, with a whole-token shortcut.

Before any document is read, the vocabulary is proved: each of its strings is encoded alone by the
library, and those that come out as one token form the whole-token set. A pre-token found in that
set counts one; only the rest goes through merges. The tokens of a word after a blank are worked out once and
remembered within a bound.

Defined results: a null or empty text has no bytes and no tokens; null ids stay null; repeated rows
give repeated results; an empty table gives an empty result; other columns take no part. Texts are
read whole. Counts do not depend on order, so ties cannot arise.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache, wraps

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits text before merging. White space is spelled out, as the
#: library's class holds no information separators.
_WS = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Characters of the words that a worker remembers between batches, and what an entry adds to its word.
REMEMBERED = 1 << 25
ENTRY = 96


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary: printable bytes for themselves, then 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def once_a_file(prove):
    """``prove(path)`` worked out once a process while the file stays as it is; each time would leave some 20 MB to the driver."""
    held = lru_cache(maxsize=4)(lambda path, size, changed: prove(path))

    @wraps(prove)
    def of(path: str):
        now = os.stat(path)
        return held(path, now.st_size, now.st_mtime_ns)

    return of


@once_a_file
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that the library encodes, alone, as exactly one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    of = byte_alphabet()
    spelled = []
    for piece, _ in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
        try:
            spelled.append(bytes(of[c] for c in piece).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token
    # one by one: a batch holds all encodings at once, and each of the library's threads keeps memory of its own
    return frozenset(s for s in spelled if s and len(tokenizer.encode(s, add_special_tokens=False).ids) == 1)


@once_a_file
def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The rank of each vocabulary string, where merging by the rank of the result is proved to equal the library.

    The library merges listed pairs only. Two tokens that join to a string of the vocabulary without being its
    listed pair could part the two ways, but then the library, given that string alone, ends with these two; so
    none exists where it gives one token for every string. None where that, or the order of ranks, does not hold.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    tokenizer, of = Tokenizer.from_file(path), byte_alphabet()
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    made = [a + b for a, b in pairs]
    if len(set(made)) < len(made) or not set(of) <= set(model["vocab"]) or any(len(tokenizer.model.tokenize(x)) != 1 for x in made):
        return None
    spelled = [*sorted(of, key=of.get), *made]
    return {bytes(of[c] for c in x): i for i, x in enumerate(spelled)}


class Counting:
    """Counts tokens of texts; one for each worker process."""

    def __init__(self, path: str, whole: frozenset[str], ranks: dict[bytes, int] | None = None):
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.pieces = regex.compile(PRE_TOKEN)
        if ranks is None:
            from tokenizers import Tokenizer

            # tasks are the parallelism; threads of the library's own would each hold memory
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.merge = lambda x: len(library.encode(x, add_special_tokens=False))
        else:
            import tiktoken

            merging = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.merge = lambda x: len(merging.encode_ordinary(x))
        self.blank_after = re.compile(f" [{_WS}]")
        self.cut = re.compile(f" (?=[^{_WS}])")
        self.whole = whole
        self.after: dict[str, int] = {}
        self.held = 0

    def words(self, part: str) -> list[str]:
        """``part`` cut at blanks; joined by blanks they give it back.

        A pre-token never runs from another character into a white space, and a blank before another character
        starts one. So a cut before a blank changes no pre-token, but for a blank within a run of white space.
        """
        return self.cut.split(part) if self.blank_after.search(part) else part.split(" ")

    def spelled(self, strings: list[str]) -> list[int]:
        """Tokens of each string: whole tokens count one, merges for the rest, once a call."""
        merged: dict[str, int] = {}
        out = []
        for s in strings:
            found = self.pieces.findall(s)
            n = 0
            for x in found:
                if x in self.whole:
                    n += 1
                else:
                    if x not in merged:
                        merged[x] = self.merge(x)
                    n += merged[x]
            out.append(n)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a word after a blank is counted once and remembered."""
        if self.held > REMEMBERED:
            self.after.clear()
            self.held = 0
        fixed, firsts, follow = [], [], []
        for text in texts:
            parts = [text or ""]
            if text and any(x in text for x in self.added):
                parts = self.special.split(text)
            fixed.append(len(parts) - 1)
            heads, others = [], []
            for part in parts:
                head, *tail = self.words(part)
                heads.append(head)
                others += tail
            firsts.append(heads)
            follow.append(others)
        lacking = list(set().union(*follow).difference(self.after))
        self.after.update(zip(lacking, self.spelled([" " + x for x in lacking])))
        self.held += sum(map(len, lacking)) + ENTRY * len(lacking)
        first = iter(self.spelled([x for heads in firsts for x in heads]))
        return [n + sum(next(first) for _ in heads) + sum(map(self.after.__getitem__, others)) for n, heads, others in zip(fixed, firsts, follow)]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, group: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    ``path`` is the tokenizer file, which every machine has in the same place. What is broadcast is
    bounded by the vocabulary.
    """
    proved = docs.sparkSession.sparkContext.broadcast((whole_tokens(path), merge_ranks(path)))

    def count(batches):
        counting = Counting(path, *proved.value)
        for batch in batches:
            texts, n = batch.column(1), []
            for at in range(0, len(texts), group):
                n += counting.counts(texts.slice(at, group).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
