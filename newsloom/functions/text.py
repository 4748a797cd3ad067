"""Text columns: cleaning, cutting, hashing, levels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate_words(text: Column, n: int) -> Column:
    """At most ``n`` characters, without the last partial word, then an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, n), r" [^ ]*$", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def url_identity(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def content_level(content: Column, min_chars: int = 200, min_paragraphs: int = 2) -> Column:
    """Whether a body is full, an excerpt, or absent."""
    long = (F.length(content) >= min_chars) & (F.size(F.split(content, "\n\n")) >= min_paragraphs)
    return F.when(content.isNull() | (F.length(content) == 0), "metadata_only").when(long, "full").otherwise("excerpt")


#: Legal words that do not tell companies apart.
LEGAL_WORDS = ("sas", "sasu", "sarl", "sa", "inc", "ltd", "gmbh", "france", "group", "groupe")


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def ascii_folded(text: Column) -> Column:
    """ASCII only: accents go, ligatures and fractions become their letters, what has no ASCII form goes.

    Only texts with other characters leave the JVM.
    """
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_decomposed(other), text)


def slug(text: Column) -> Column:
    """ASCII words in lower case, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_folded(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def name_keys(name: Column) -> Column:
    """``joined`` and ``sorted`` key of a company name without legal words; null if under four characters are left."""
    words = F.regexp_extract_all(F.lower(ascii_folded(name)), F.lit(r"([a-z0-9]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS))
    joined = F.array_join(kept, "")
    return F.when(F.length(joined) >= 4, F.struct(joined.alias("joined"), F.array_join(F.sort_array(kept), " ").alias("sorted")))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    from html import unescape

    return text.map(unescape, na_action="ignore")


def strip_html(text: Column) -> Column:
    """Visible text: block ends become lines, tags go, entities are decoded, blanks collapse; null and empty stay."""
    # fixed values: the tags that end a line
    out = F.regexp_replace(text, r"(?i)<br\s*/?\s*>|</(?:p|div|h[1-6]|li|tr|blockquote)>", "\n")
    out = _unescaped(F.regexp_replace(out, r"<[^>]+>", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?U)\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n"), r"(?U)^\s+|\s+$", "")


def sector_group(sector: Column, groups: dict[str, list[str]]) -> Column:
    """The group of that name, else of the keyword that starts a word earliest; ties go to the first group; else Other."""
    low = F.lower(sector)
    found = []
    for rank, (group, keywords) in enumerate(groups.items()):
        for word in keywords:
            start = F.regexp_instr(low, F.lit(rf"(?<![a-z])\Q{word.lower()}\E"))
            found.append(F.when(start > 0, F.struct(start.alias("at"), F.lit(rank).alias("rank"), F.lit(group).alias("group"))))
    best = F.array_min(F.array_compact(F.array(*found)))["group"]
    return F.when(sector.isin(*groups), sector).otherwise(F.coalesce(best, F.lit("Other")))


def body_matches_title(title: Column, body: Column) -> Column:
    """Whether at least four fifths of the paragraphs differ and, unless the title has none, one of its words is in the body."""
    paragraphs = F.filter(F.transform(F.split(body, "\n\n"), lambda p: F.lower(collapse_space(p))), lambda p: p != "")
    varied = (F.size(paragraphs) > 0) & (F.size(F.array_distinct(paragraphs)) >= F.size(paragraphs) * 0.8)
    # fixed values: words too common to tell
    small = ("the", "and", "with", "for", "les", "des", "une", "dans", "pour", "sur", "avec")
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)(\w+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*small))
    pairs = F.flatten(F.transform(F.regexp_extract_all(title, F.lit("([\u3400-\u9fff]{2,})"), 1), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    told = F.concat(words, pairs)
    return F.coalesce(varied & ((F.size(told) == 0) | F.exists(told, lambda w: F.contains(F.lower(body), w))), F.lit(False))


def titles_match(first: Column, second: Column) -> Column:
    """Whether half of the smaller title's words are in the other."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), 1))
    a, b = words(first), words(second)
    least = F.least(F.size(a), F.size(b))
    return F.coalesce((least > 0) & (F.size(F.array_intersect(a, b)) * 2 >= least), F.lit(False))


@F.pandas_udf(StringType())
def _casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def visible_text_hash(text: Column) -> Column:
    """SHA-256 of a text after compatibility composition, case folding and collapsing of white space."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.sha2(collapse_space(F.coalesce(_casefolded(other), F.lower(text))), 256)


def canonical_json_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of some columns with names in order; missing values are null in it."""
    return F.sha2(F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def infer_sector(text: Column, sectors: dict[str, list[str]]) -> Column:
    """The sector with the most keywords in the text, case aside; of equal ones the first; null without any."""
    low = F.lower(text)
    scored = []
    for rank, (name, keywords) in enumerate(sectors.items()):
        hits = F.lit(0)
        for word in keywords:
            hits = hits + F.coalesce(F.contains(low, F.lit(word.lower())), F.lit(False)).cast("int")
        scored.append(F.struct(hits.alias("hits"), F.lit(-rank).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"])


def website_or_null(url: Column) -> Column:
    """The address if it is http(s) without user info, on port 80 or 443, with a public host, of at most 500 characters."""
    host = F.lower(F.regexp_extract(url, r"\A(?i:https?)://([^/?#:@\s]+)(?::(?:80|443))?(?:[/?#]\S*)?\z", 1))
    private = host.rlike(r"\A(?:localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*)\z")
    return F.when((F.length(url) <= 500) & F.contains(host, F.lit(".")) & ~private, url)


def token_bound(messages: Column, each: int = 8, fixed: int = 64) -> Column:
    """An upper bound of the tokens of messages: their UTF-8 bytes, ``each`` more for a message, and ``fixed``."""
    return F.aggregate(messages, F.lit(fixed), lambda n, m: n + F.octet_length(m) + each)


#: Characters of a text that each task reads; any other reads the most.
TASK_CHARS = {"extract_companies": 20_000, "translate": 30_000}


def task_input(text: Column, task: Column, most: int = 50_000) -> Column:
    """The visible text, cut to what the task reads."""
    limit = F.coalesce(*[F.when(task == k, F.lit(v)) for k, v in TASK_CHARS.items()], F.lit(most))
    return F.substring(strip_html(text), F.lit(1), limit)
