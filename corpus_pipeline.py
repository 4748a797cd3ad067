"""From raw documents to packed training batches, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the
last return the columns of ``documents``.

Defined results: null and empty texts fail the quality rules; of repeated rows one stays from near
dedup on; columns of any name and type pass through all stages but the last; an empty table, given or
left by a stage, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import MADE, discard, stored
from newsloom.llm.packing import pack
from newsloom.llm.pii import without_pii
from newsloom.llm.quality import kept_documents
from newsloom.llm.queries import tokenizer
from newsloom.llm.simhash import drop_near_copies
from newsloom.llm.substrings import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere leave the texts."""
    return without_repeats(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in angle brackets."""
    return without_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, a batch and a slot for each document."""
    return pack(docs, path=tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", hide_personal_data),
    ("packing", packing),
]

#: Near copies by least hashes, replacement by checksum and optimal buckets are beyond SQL; tests hold each stage
#: against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents``; each stage is written and read again.

    What a stage left in the shared folder goes once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(MADE)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
            discard(spark, [p for p in MADE[:-1] if p not in others])
    return docs
