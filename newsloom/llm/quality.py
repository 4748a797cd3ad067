"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Per document: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
the ratios that the rule table names, ``base_failed``, ``failed_rules`` and ``kept``.

Defined results: a null or blank text has no words, fails the word count and is not kept; a null
doc_id stays null; repeated rows give repeated results; an empty table gives an empty result; other
columns, whatever their names, take no part. Texts of any length are read whole. There is no
ordering, so ties cannot arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import SPACES, aside, restored, words_column

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with is in it for on as by this from are was a an or at "
    "la le les de des du et en un une que qui est pour par dans sur au ce il elle "
    "el los las y del se su para como con por "
    "der die das und den dem ist ein eine mit von zu nicht auf im"
).split()
#: Bits of a sort key that hold a word's position; the other 33 hold a hash.
POSITION_BITS = 31


@dataclass(frozen=True)
class Rule:
    """A document fails when ``ratio`` is below ``least`` or above ``most``."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. Each is wide of what running prose in any of the languages reaches.
RULES = (
    Rule("short words", "mean_word_chars", least=1.5),
    Rule("long words", "mean_word_chars", most=25.0),
    Rule("symbols", "symbols_per_word", most=0.5),
    Rule("no stop words", "stop_word_ratio", least=0.01),
    Rule("repeated lines", "dup_line_ratio", most=0.5),
)


def _measures(docs: DataFrame) -> DataFrame:
    """Internal columns ``__*`` beside ``docs``; each array is used twice, so it is made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    low = (1 << POSITION_BITS) - 1
    out = docs.withColumns({"__words": words_column(F.col("text")), "__lines": lines, "__text": text})
    triple = F.transform(
        "__words",
        lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    out = out.withColumns(
        {
            "__n": F.size("__words").cast("long"),
            "__keys": F.sort_array(F.slice(triple, 1, F.greatest(F.size("__words") - 2, F.lit(0)))),
        }
    )
    same = lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
    near = F.filter("__keys", lambda k, j: F.coalesce(same(k, F.get("__keys", j - 1)), F.lit(False)) | F.coalesce(same(k, F.get("__keys", j + 1)), F.lit(False)))
    # windows that share a hash with another, told apart by their words
    at = lambda k: k.bitwiseAND(F.lit(low)).cast("int")
    named = F.transform(near, lambda k: F.struct(F.array_join(F.slice("__words", at(k) + 1, 3), " ").alias("s"), at(k).alias("p")))
    out = out.withColumn("__named", F.sort_array(named))
    again = F.filter("__named", lambda x, j: F.coalesce(x.s == F.get("__named", j - 1).s, F.lit(False)) | F.coalesce(x.s == F.get("__named", j + 1).s, F.lit(False)))
    out = out.withColumn("__at", F.sort_array(F.transform(again, lambda x: x.p)))
    covered = F.transform("__at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__at", j + 1) - p, F.lit(3))))
    return out.withColumn("__repeat", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``row`` and ``text``, the input with its other columns in one struct, and beside them the measures and the verdict."""
    text = F.col("__text")
    n = F.col("__n")
    counts: dict[str, Column] = {
        "n_words": n,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.col("__repeat"),
    }
    whole = F.greatest(n, F.lit(1)).cast("double")
    ratios = {
        "mean_word_chars": F.col("word_chars") / whole,
        "symbols_per_word": F.col("n_symbols") / whole,
        "stop_word_ratio": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))) / whole,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)),
    }
    broken = []
    for rule in rules:
        value, bad = F.col(rule.ratio), F.lit(False)
        bad = bad | (value < rule.least) if rule.least is not None else bad
        bad = bad | (value > rule.most) if rule.most is not None else bad
        broken.append(F.when(bad, F.lit(rule.name)))
    out = _measures(aside(docs)).withColumns(counts).withColumns(ratios)
    base = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    out = out.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are.

    The row number keeps the optimizer from moving the filter below the projections, where each use
    of an array of words would split the text again.
    """
    told = quality(docs, rules).withColumn("at", F.monotonically_increasing_id())
    return told.where("kept and at >= 0").select(*restored(docs.columns))
