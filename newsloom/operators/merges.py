"""Upserts, merges and differences as joins; each gives the outcome per row and writes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import with_checkpoints
from newsloom.functions.text import name_keys

#: Content levels, best last.
LEVELS = ("metadata_only", "excerpt", "full")


def level_rank(level: Column, content: Column) -> Column:
    """A level that is not known counts as full with a body, else as metadata."""
    known = F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1
    return F.when(level.isin(*LEVELS), known).when(F.coalesce(F.length(content), F.lit(0)) > 0, 2).otherwise(0)


def upsert_articles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What happens to each incoming article: new, updated, duplicate or conflict.

    It is met by source and external id, else by source and address. Only a better content level
    replaces a stored one; a better one under another address is a conflict, which fails its source
    (``source_failed``). ``incoming`` holds each external id once.
    """
    s = stored.select("source_id", F.col("id").alias("by"), "external_id", "url", level_rank(F.col("content_level"), F.col("content")).alias("old"))
    met = lambda name, key: s.select("source_id", key, F.struct("by", "url", "old").alias(name))
    by_url = s.groupBy("source_id", "url").agg(F.min(F.struct("by", "url", "old")).alias("u"))
    both = incoming.join(met("e", "external_id"), ["source_id", "external_id"], "left").join(by_url, ["source_id", "url"], "left")
    found = both.withColumn("hit", F.coalesce("e", "u")).withColumn("level", level_rank(F.col("content_level"), F.col("content")))
    action = (
        F.when(F.col("hit").isNull(), "new")
        .when(F.col("level") <= F.col("hit.old"), "duplicate")
        .when(F.col("hit.url") != F.col("url"), "conflict")
        .otherwise("updated")
    )
    told = found.select("source_id", "external_id", "url", F.col("hit.by").alias("stored_id"), action.alias("action"))
    failed = F.max(F.col("action") == "conflict").over(Window.partitionBy("source_id"))
    return told.withColumn("source_failed", failed)


#: What an article keeps from before where the new row says nothing, and what a better body makes void.
KEPT = ("author", "image_url", "published_at")
VOID = ("content_zh", "content_en", "insight_zh", "insight_en", "summary_fr", "summary_zh", "summary_en")


def merged_articles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows, new and updated, that an upsert leaves, in the columns of ``stored``, with their ``action``.

    An update takes title, content, level and language from the new row, keeps author, image and date where that has none, and
    voids what was made from the old body: it is not processed, translations and summaries go, translated titles too if the
    title differs. Rows of sources with a conflict change nothing. A new row has no ``id`` yet; other columns of it are null.
    """
    told = upsert_articles(stored, incoming).where("not source_failed and action in ('new', 'updated')").select("source_id", "external_id", "stored_id", "action")
    old = stored.select(F.col("id").alias("stored_id"), F.struct(*stored.columns).alias("old"))
    new = incoming.select("source_id", "external_id", F.struct(*incoming.columns).alias("new"))
    both = told.join(new, ["source_id", "external_id"]).join(old, "stored_id", "left")

    def column(c: str) -> Column:
        given = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        if c in ("id", "external_id"):
            return F.col(f"old.{c}") if c == "id" else F.coalesce(F.col("old.external_id"), given)
        if c == "processed":
            return F.lit(False)
        if c in KEPT:
            return F.coalesce(given, F.col(f"old.{c}"))
        if c in VOID:
            return F.lit(None)
        if c in ("title_zh", "title_en"):
            return F.when(F.col("old.title").eqNullSafe(F.col("new.title")), F.col(f"old.{c}"))
        return given if c in incoming.columns else F.col(f"old.{c}")

    return both.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in stored.schema], "action")


def resolved(pairs: DataFrame, most: int = 40) -> DataFrame:
    """``target_id, duplicate_id`` with targets that are no duplicates themselves; the way halves each round."""
    with_checkpoints(pairs.sparkSession)
    at = pairs.select("target_id", "duplicate_id").where("target_id <> duplicate_id").checkpoint()
    for _ in range(most):
        onward = at.select(F.col("duplicate_id").alias("target_id"), F.col("target_id").alias("further"))
        met = at.join(onward, "target_id", "left").checkpoint()
        at = met.select(F.coalesce("further", "target_id").alias("target_id"), "duplicate_id")
        if met.where("further is not null").isEmpty():
            return at
    raise ValueError("companies merge in a circle")


def merge_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mentions after companies merge: ``pairs`` says which ``duplicate_id`` goes into which ``target_id``,
    once each; a target that is merged itself passes on what it gets.

    Where both knew an article, the target's mention is kept and enriched, duplicates in order of id:
    the larger count, primary if either is, and a duplicate's sentiment with its score where the
    target's says nothing; a missing score is filled where the labels agree.
    """
    pairs = resolved(pairs)
    moved = links.join(pairs, links["company_id"] == pairs["duplicate_id"], "left")
    target = F.coalesce("target_id", "company_id")
    known = moved.groupBy("article_id", target.alias("company_id")).agg(
        F.max("mention_count").alias("mention_count"),
        F.max("is_primary").alias("is_primary"),
        F.array_sort(F.collect_list(F.struct(F.col("target_id").isNotNull().alias("moved"), F.col("company_id").alias("by"), "sentiment", "score"))).alias("told"),
    )
    says_nothing = lambda x: x.isNull() | (x == "neutral")

    def enrich(kept: Column, other: Column) -> Column:
        takes = says_nothing(kept["sentiment"]) & ~says_nothing(other["sentiment"])
        fills = ~takes & kept["score"].isNull() & kept["sentiment"].eqNullSafe(other["sentiment"])
        return F.struct(F.when(takes, other["sentiment"]).otherwise(kept["sentiment"]).alias("sentiment"), F.when(takes | fills, other["score"]).otherwise(kept["score"]).alias("score"))

    first = F.element_at("told", 1)
    start = F.struct(first["sentiment"].alias("sentiment"), first["score"].alias("score"))
    out = F.aggregate(F.slice("told", 2, F.size("told")), start, enrich)
    return known.withColumn("out", out).select("article_id", "company_id", "mention_count", "is_primary", "out.sentiment", "out.score")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], cut: int = 200) -> DataFrame:
    """One row per field that differs between two versions of an entity, texts cut to ``cut`` characters."""
    side = lambda df, name: df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    both = side(old, "o").join(side(new, "n"), key)
    change = lambda f: F.struct(F.lit(f).alias("field"), F.substring(F.col(f"o.{f}"), 1, cut).alias("before"), F.substring(F.col(f"n.{f}"), 1, cut).alias("after"), (~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))).alias("differs"))
    rows = both.select(key, F.inline(F.array(*map(change, fields))))
    return rows.where("differs").drop("differs")


def coverage_diff(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, once, as equal, missing or extra."""
    a, b = expected.select(*keys).distinct().withColumn("e", F.lit(True)), found.select(*keys).distinct().withColumn("f", F.lit(True))
    verdict = F.when(F.col("e").isNull(), "extra").when(F.col("f").isNull(), "missing").otherwise("equal")
    return a.join(b, keys, "full_outer").select(*keys, verdict.alias("verdict"))


#: Rounds that a search for components may take; chains of 2^63 nodes need fewer.
MOST_ROUNDS = 64


def _components(edges: DataFrame) -> DataFrame:
    """``node, root``: smallest node that each node of ``edges (a, b)`` reaches; each round halves the way at least for chains."""
    with_checkpoints(edges.sparkSession)
    both = edges.union(edges.select("b", "a")).toDF("node", "other").distinct().checkpoint()
    roots = both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("root"))
    for _ in range(MOST_ROUNDS):
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        low = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = low.join(jump, "low").select("node", F.least("low", "far").alias("next"), (F.least("low", "far") != F.col("root")).alias("moved")).checkpoint()
        roots = step.select("node", F.col("next").alias("root"))
        if not step.where("moved").limit(1).count():
            return roots
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def duplicate_companies(companies: DataFrame) -> DataFrame:
    """``id, keeper_id, group_size`` of companies whose names collide by either key, transitively.

    Components are searched among distinct pairs of keys, not companies, so a name that very many
    share is one node. Rejected companies take no part. The keeper was not created automatically if any was not, then has the lowest id.
    """
    keyed = companies.where("review_status is null or review_status <> 'rejected'").select("id", "is_auto_created", name_keys(F.col("name")).alias("k")).where("k is not null")
    roots = _components(keyed.select("k.joined", "k.sorted").distinct().toDF("a", "b"))
    member = keyed.join(roots, F.col("k.joined") == F.col("node")).select("id", "is_auto_created", "root")
    group = member.groupBy("root").agg(F.min(F.struct("is_auto_created", "id"))["id"].alias("keeper_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return member.join(group, "root").select("id", "keeper_id", "group_size")
