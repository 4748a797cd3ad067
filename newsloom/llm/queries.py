"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import crosstok, licenses, pieces, turns
from newsloom.llm.ann import nearest
from newsloom.llm.common import stored
from newsloom.llm.lm import score
from newsloom.llm.packing import pack
from newsloom.llm.pii import digest, find_pii
from newsloom.llm.quality import STOP_WORDS, quality
from newsloom.llm.simhash import simhash_components
from newsloom.llm.substrings import remove_repeats
from newsloom.llm.tokens import token_counts
from newsloom.llm.warc import round_trip

#: Where every machine has the public tokenizer files.
TOKENIZERS = os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path=tokenizer("byte_bpe_50k.json"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one turn in five dropped, emptied, cut, repeated or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    hurt = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    told = stored(turns.audits(turns.judged(rows)), "turn-audits")
    marks = turns.digests(turns.repaired(rows, told))
    out = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = out.join(told, F.col("id").eqNullSafe(told.conv_id), "left").drop("conv_id")
    out = out.join(marks, F.col("id").eqNullSafe(marks.conv_id), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *turns.FAULTS, "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_substring_dedup, op2_lm_scoring, op3_token_counts, op4_simhash, op5_nearest_neighbours, op6_pii, op7_warc, op8_sentencepiece, op9_quality, op10_packing, op11_turn_repair, op12_cross_tokenizer, op13_license_scan, pipeline)
    return {f.__name__: f for f in each}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
windows AS (
  SELECT r, p AS i, string_agg(word, ' ') OVER whole AS s FROM words
  WINDOW whole AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
  QUALIFY count(*) OVER whole = 35
),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.r = docs.r
"""

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

#: The base columns and the verdict of the quality rules, with their thresholds written out.
OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
triples AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
again AS (SELECT r, i FROM triples QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
),
base AS (
  SELECT doc_id, len(w) AS n, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS symbols,
    coalesce(lines.n - lines.d, 0) AS dup, coalesce(lines.n, 0) AS n_lines, coalesce(covered.n, 0) AS rep,
    len(list_filter(w, lambda x: list_contains({_STOP_SQL}, lower(x)))) AS stops
  FROM docs LEFT JOIN lines ON lines.r = docs.r LEFT JOIN covered ON covered.r = docs.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
  CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  (n < 50 OR 100 * rep > 50 * n) AS base_failed,
  NOT (n < 50 OR 100 * rep > 50 * n) AND chars / n::DOUBLE BETWEEN 1.5 AND 25 AND symbols / n::DOUBLE <= 0.5
    AND stops / n::DOUBLE >= 0.01 AND dup / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept
FROM base
"""


_CRC_ITEMS = "list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
_CRC = f"xor(list_reduce({_CRC_ITEMS}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"

#: The edits as a walk over states (0 no role yet, 1 system, 2 user, 3 assistant) instead of an alignment. One insertion
#: between two turns is enough: two of them cost 10 and lead back to the same role, or from no role where deleting is cheaper.
OP11_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS how FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS n FROM hit WHERE how <> 0
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM hurt),
told AS (
  SELECT *, CASE WHEN shown = '' THEN 1 WHEN again THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS pos
  FROM seen
),
pairs AS (SELECT conv_id, i || lead(i) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM told),
bad AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, max(pos) AS n FROM told GROUP BY conv_id
),
moves(state, role, goes) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
walk AS (
  SELECT conv_id, 0 AS pos, 0 AS state, {{'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS w FROM counts
  UNION ALL
  SELECT conv_id, pos, state, min(w) AS w FROM (
    SELECT f.conv_id, t.pos, m.goes AS state, {{'cost': f.w.cost + m.cost, 'audit': f.w.audit || m.edit, 'said': list_concat(f.w.said, m.said)}} AS w
    FROM (
      SELECT conv_id, pos, state, w FROM walk
      UNION ALL
      SELECT conv_id, pos, goes, {{'cost': w.cost + 5, 'audit': w.audit || 'I', 'said': list_append(w.said, CASE role WHEN 'u' THEN 'user:' ELSE 'assistant:' END)}} FROM walk JOIN moves USING (state) WHERE role <> 's'
    ) f JOIN told t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1
    CROSS JOIN LATERAL (
      SELECT f.state AS goes, 2 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS said
      UNION ALL
      SELECT goes, CASE WHEN t.i = role THEN 0 ELSE 1 END + CASE t.fault WHEN 3 THEN 5 ELSE 0 END, CASE WHEN t.i = role THEN 'K' ELSE 'R' END,
        [CASE WHEN t.i = role THEN t.role WHEN role = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text]
      FROM moves WHERE moves.state = f.state AND t.fault IN (0, 3) AND (role <> 's' OR t.i = 's')
    ) m
  ) GROUP BY conv_id, pos, state
),
last AS (
  SELECT conv_id, min(w) AS w FROM (
    SELECT w.conv_id, CASE WHEN w.state = 2 THEN {{'cost': w.w.cost + 5, 'audit': w.w.audit || 'I', 'said': list_append(w.w.said, 'assistant:')}} ELSE w.w END AS w
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos WHERE w.state IN (0, 2, 3)
  ) GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(last.w.cost, 0) AS BIGINT) AS cost, coalesce(last.w.audit, '') AS audit, sha256(coalesce(array_to_string(last.w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_NOTICE = " (released|licensed|distributed|available) under( the terms of)? the"
_CC = " (released|licensed|distributed|available) under( a)?( the)?"
_CC_VERSION = " (2 0|2 5|3 0|4 0) "
_AS_IS_SQL = " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall( [^ ]+){1,8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software "
_BSD_SQL = " redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met( 1)? redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer( 2)? redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_LAST = " this software is provided by( [^ ]+){1,12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
_GPL_SQL = " this (program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version "
#: The templates written as patterns over words joined by blanks.
_PATTERNS = {
    "mit-text": " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software" + _AS_IS_SQL,
    "isc-text": " permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies ",
    "bsd-2-clause-text": _BSD_SQL + _BSD_LAST,
    "bsd-3-clause-text": _BSD_SQL + "( 3)? neither the name of( [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" + _BSD_LAST,
    "apache-2.0-text": " licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at( http)?( https)? www apache org licenses license 2 0( html)?( txt)? unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied ",
    "gpl-2.0-or-later-text": _GPL_SQL.format(2),
    "gpl-3.0-or-later-text": _GPL_SQL.format(3),
    "mit-notice": _NOTICE + " mit license ",
    "apache-2.0-notice": _NOTICE + " apache license( version)? 2 0 ",
    "gpl-2.0-notice": _NOTICE + " gnu general public license (version 2|v2) ",
    "gpl-3.0-notice": _NOTICE + " gnu general public license (version 3|v3) ",
    "cc-by-notice": _CC + " (cc by|creative commons attribution)" + _CC_VERSION,
    "cc-by-sa-notice": _CC + " (cc by sa|creative commons attribution sharealike)" + _CC_VERSION,
    "cc-by-nc-notice": _CC + " (cc by nc|creative commons attribution noncommercial)" + _CC_VERSION,
    "rights-reserved": " copyright( c)?( [^ ]+){1,12} all rights reserved ",
}
_METHOD = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in _PATTERNS.items())
_BASES = "list_concat(list_transform(list_filter(ix, lambda i: w[i] = 'mit' AND w[i + 1] = 'license'), lambda i: {'p': i - 1, 'l': 'mit'}), list_transform(list_filter(ix, lambda i: w[i] = 'apache' AND w[i + 1] = 'license'), lambda i: {'p': i - 1, 'l': 'apache'}), list_transform(list_filter(ix, lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'), lambda i: {'p': i - 1, 'l': 'gpl'}))"

OP13_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, range(1, len(w) + 1) AS ix, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
m AS (SELECT doc_id, len(w) AS n, {_BASES} AS b, list_filter([{_METHOD}], lambda x: x IS NOT NULL) AS own FROM t)
SELECT doc_id, n AS n_words, len(b) AS n_base, list_min(list_transform(b, lambda x: x.p)) AS first_word, list_max(list_transform(b, lambda x: x.p)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, list_transform(b, lambda x: x.l)))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op9_quality": OP9_SQL, "op11_turn_repair": OP11_SQL, "op13_license_scan": OP13_SQL}
