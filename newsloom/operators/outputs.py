"""Outputs of language models against the contracts of their tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.documents import Rule, broken_rules, duplicate_keys, json_nodes
from newsloom.sources.recipes import RECIPE, recipe_failures

#: What the tasks may answer.
CATEGORIES = ("semiconductor", "ai", "software", "cloud", "cybersecurity", "iot", "energy", "automotive", "aerospace", "biotech", "startup", "fintech", "telecom", "research")
HIGHLIGHTS = ("tech_breakthrough", "local_research", "investment", "local_event")
STAGES = ("startup", "scale-up", "mature")
ADVICE = ("", "重点关注", "持续监控", "一般了解")
COMPANY_TEXTS = ("overview", "founders", "spinoff_source", "core_tech", "cn_competitor_names", "business_status", "recommendation_reason")
MOST_CHARS = 200_000


def _object(pattern: str, required: tuple[str, ...], optional: tuple[str, ...] = (), nullable: bool = False) -> Rule:
    return Rule(pattern, "object", "type", required, optional, nullable=nullable, key_code="keys")


def _text(pattern: str, most: int = 4000, least: int = 0, nullable: bool = False) -> Rule:
    return Rule(pattern, "text", "text", least=least, most=most, nullable=nullable)


CONTRACTS: dict[str, tuple[Rule, ...]] = {
    "ner": (
        _object("$", ("companies",)),
        Rule("$.companies", "array", "size", most=100),
        _object("$.companies[*]", ("name", "mentions", "is_primary"), ("spinoff_origin", "company_stage", "location")),
        _text("$.companies[*].name", 300, 1),
        Rule("$.companies[*].mentions", "integer", "range", least=1, most=100_000),
        Rule("$.companies[*].is_primary", "boolean", "type"),
        _text("$.companies[*].spinoff_origin", 200, nullable=True),
        Rule("$.companies[*].company_stage", "choice", "choice", choices=STAGES, nullable=True),
        _object("$.companies[*].location", ("in_isere",), ("city", "postcode"), nullable=True),
        Rule("$.companies[*].location.in_isere", "boolean", "type"),
        _text("$.companies[*].location.city", 120, nullable=True),
        _text("$.companies[*].location.postcode", 10, nullable=True),
    ),
    "sentiment": (
        _object("$", ("sentiment", "score", "reason")),
        Rule("$.sentiment", "choice", "choice", choices=("positive", "negative", "neutral")),
        Rule("$.score", "number", "range", least=-1, most=1),
        _text("$.reason"),
    ),
    "classify": (
        _object("$", ("categories", "highlights", "event_date")),
        Rule("$.categories", "array", "size", most=14),
        _object("$.categories[*]", ("category", "confidence")),
        Rule("$.categories[*].category", "choice", "choice", choices=CATEGORIES),
        Rule("$.categories[*].confidence", "number", "range", least=0, most=1),
        Rule("$.highlights", "array", "size", most=4),
        Rule("$.highlights[*]", "choice", "choice", choices=HIGHLIGHTS),
        Rule("$.event_date", "date", "date", most=10, nullable=True),
    ),
    "company_analysis": (
        _object("$", (*COMPANY_TEXTS, "competitors", "recommendation", "website")),
        *[_text(f"$.{x}") for x in COMPANY_TEXTS],
        _text("$.website", 500),
        Rule("$.recommendation", "choice", "choice", choices=ADVICE),
        Rule("$.competitors", "array", "size", most=10),
        _object("$.competitors[*]", ("dimension", "company", "cn_competitor")),
        *[_text(f"$.competitors[*].{x}") for x in ("dimension", "company", "cn_competitor")],
    ),
}


def validate_model_output(outputs: DataFrame) -> DataFrame:
    """``output_id, valid, failures`` of ``output_id, task, text``; ``failures`` are ``code, path`` in order.

    A text of a task without a contract is valid if it is not blank and not too long. One fenced block around the JSON is
    taken off. Codes: ``size`` and ``empty`` of the whole text, ``json``, ``duplicate_key``, then those of the contract.
    """
    trimmed = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    fence = F.regexp_replace(F.regexp_extract(trimmed, r"(?s)\A```[^\n]*\n(.*)```\z", 1), r"(?U)\A\s+|\s+\z", "")
    fenced = trimmed.rlike(r"(?s)\A```[^\n]*\n.*```\z")
    held = outputs.select("output_id", "task", "text", F.when(fenced, fence).otherwise(trimmed).alias("body"))
    bound = F.col("task").isin(*CONTRACTS, RECIPE)
    first = F.when(F.length("text") > MOST_CHARS, "size").when(~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)), "empty")
    read = held.withColumn("code", first).withColumn("nodes", json_nodes(F.when(bound & F.col("code").isNull(), F.col("body"))))
    whole = F.when(F.col("code").isNotNull(), F.col("code")).when(bound & F.col("nodes").isNull(), "json")
    none = F.array().cast("array<struct<code:string,path:string>>")
    failure = lambda code, path: F.struct(code.alias("code"), path.alias("path"))
    told = F.concat(F.when(whole.isNotNull(), F.array(failure(whole, F.lit("$")))).otherwise(none), F.coalesce(F.transform(duplicate_keys(F.col("nodes")), lambda p: failure(F.lit("duplicate_key"), p)), none))
    # one reading of each text: what is told of the whole goes along with its nodes
    broken = broken_rules(read.select(F.col("output_id").alias("id"), F.col("task").alias("contract"), "nodes", told.alias("told")), CONTRACTS)
    recipes = read.where((F.col("task") == RECIPE) & F.col("nodes").isNotNull()).select(F.col("output_id").alias("id"), "nodes", F.octet_length("body").alias("size"))
    every = broken.unionByName(recipe_failures(recipes)).withColumnRenamed("id", "output_id").groupBy("output_id").agg(F.sort_array(F.collect_set(F.struct("path", "code"))).alias("found"))
    failures = F.transform(F.coalesce("found", F.array().cast("array<struct<path:string,code:string>>")), lambda x: F.struct(x.code.alias("code"), x.path.alias("path")))
    return outputs.select("output_id").join(every, "output_id", "left").select("output_id", F.col("found").isNull().alias("valid"), failures.alias("failures"))
