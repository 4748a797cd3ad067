"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts a score.

Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``; they always stay. The method adds
kinds that need more evidence: ``iban`` (mod-97), ``ssn`` and ``secret``, kept when the checksum and
the words before the span bring the score to ``keep_score``. Offsets count code points, end exclusive.

Defined results: a null or empty text has no spans; null ids stay null; repeated rows give repeated
results; an empty table gives an empty result; other columns, whatever their names and types, take no
part. Spans that start together are ordered by kind as listed. Texts are
read whole, and every scan takes time in proportion to the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import aside, restored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: How sure a pattern alone makes us, what a passed checksum adds and what a context word adds.
PATTERN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.4, "secret": 0.4}
CHECKSUM_SCORE = 0.5
CONTEXT_SCORE = 0.35
CONTEXT_CHARS = 48
#: Words that make a kind likelier when they stand shortly before the span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "pay", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password", "api"),
}

#: Characters of an account number in each country of the registry.
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
        "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])")
_NOT_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str):
    """Spans that pass mod-97, each at its country's length (elsewhere the whole run): more letters and digits may follow a blank."""
    free = 0
    for m in _IBAN.finditer(text):
        start, end = m.span(1)
        length = IBAN_LENGTH.get(text[start : start + 2])
        if length:
            places = [i for i in range(start, end) if text[i] != " "]
            if len(places) < length:
                continue
            end = places[length - 1] + 1
        after = text[end : end + 1]
        if start >= free and not (after.isascii() and after.isalnum()) and mod97(text[start:end].replace(" ", "")):
            yield start, end
            free = end


def emails(text: str):
    """Matches of the address pattern, found from each ``@`` so that long runs cost no more."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().translate(_NOT_DIGIT)
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m.group().translate(_NOT_DIGIT)) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def score(text: str, start: int, kind: str, checked: bool) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start].lower()
    words = set(re.findall(r"[a-z]+", near))
    return min(1.0, PATTERN_SCORE[kind] + CHECKSUM_SCORE * checked + CONTEXT_SCORE * bool(words.intersection(CONTEXT[kind])))


def added_spans(text: str, keep_score: float) -> list[tuple[int, int, str]]:
    found = []
    proposed = [(a, b, "iban") for a, b in ibans(text)]
    proposed += [(m.start(), m.end(), kind) for kind, pattern in (("ssn", _SSN), ("secret", _SECRET)) for m in pattern.finditer(text)]
    for start, end, kind in proposed:
        if score(text, start, kind, kind == "iban") >= keep_score:
            found.append((start, end, kind))
    return found


def spans_of(text: str | None, keep_score: float) -> tuple[list, list]:
    """Base spans, and all spans, each in order of start and kind."""
    if not text:
        return [], []
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    more = added_spans(text, keep_score) if re.search("[0-9]", text) else []
    return base, sorted(base + more, key=order) if more else base


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the union is replaced under the first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))


def find_pii(docs: DataFrame, keep_score: float = 0.7, redact: bool = False) -> DataFrame:
    """``row, text, spans``: the other columns of each row in a struct, its text, and its spans as an array of
    ``kind, start, end, score, base``; with ``redact`` they are replaced in ``text``."""
    rows = aside(docs)
    out = T.StructType([*rows.schema.fields, T.StructField("spans", _SPAN)])

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            texts, found, changed = batch.column("text"), [], []
            for value in texts:
                text = value.as_py()
                base, spans = spans_of(text, keep_score)
                found.append([{"kind": k, "start": a, "end": b, "score": score(text, a, k, k in ("card", "iban")), "base": k in BASE_KINDS} for a, b, k in spans])
                if redact:
                    changed.append(redacted(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(changed, texts.type) if redact else texts, pa.array(found, kind)], ["row", "text", "spans"])

    return rows.mapInArrow(scan, out)


def without_pii(docs: DataFrame, keep_score: float = 0.7) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind; all other columns as they are."""
    return find_pii(docs, keep_score, redact=True).select(*restored(docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of the rows of ``find_pii``, by built-in expressions."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = written(F.filter("spans", lambda s: s.base))
    return found.select("row.doc_id", *map(of, BASE_KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
