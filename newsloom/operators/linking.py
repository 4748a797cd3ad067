"""Companies and categories of articles: linking, new entities, guarded updates, merges of analyses.

Each operator gives the rows to store, or what becomes of each row; none writes.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import slug
from newsloom.functions.times import moment


def link_mentions(extracted: DataFrame, companies: DataFrame) -> DataFrame:
    """``article_id, company_id, name, slug, status`` of each extracted company name.

    A name meets the company with its slug, else the company with that alias in any case, the lowest id
    first. Names without either are new (``company_id`` null): approved, or pending if they are local.
    Of names with one slug in an article, and of names that meet one company, the first stays.
    ``extracted``: ``article_id, position, name, is_local``; ``companies``: ``id, slug, aliases``.
    """
    named = extracted.withColumn("name", F.trim("name")).withColumn("slug", slug(F.col("name"))).where("slug <> ''")
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct("position", "name")).alias("x")).select(*keys, "x.*")
    named = first(named, "article_id", "slug")
    by_slug = companies.groupBy("slug").agg(F.min("id").alias("by_slug"))
    alias = companies.select("id", F.explode("aliases").alias("alias")).groupBy(F.lower("alias").alias("alias")).agg(F.min("id").alias("by_alias"))
    met = named.join(by_slug, "slug", "left").join(alias, F.lower("name") == F.col("alias"), "left")
    met = met.withColumn("company_id", F.coalesce("by_slug", "by_alias"))
    known = first(met.where("company_id is not null").select("article_id", "company_id", "position", "name", "slug"), "article_id", "company_id")
    out = known.select("article_id", "company_id", "name", "slug", F.lit("known").alias("status"))
    new = met.where("company_id is null").select("article_id", "company_id", "name", "slug", F.when(F.col("is_local"), "pending").otherwise("approved").alias("status"))
    return out.unionByName(new)


def link_categories(told: DataFrame, categories: DataFrame) -> DataFrame:
    """``article_id, category_id, confidence``: unknown slugs are left out, the last confidence told wins."""
    met = told.join(categories.select(F.col("id").alias("category_id"), "slug"), F.col("category") == F.col("slug"))
    return met.groupBy("article_id", "category_id").agg(F.max_by("confidence", F.struct("position", "confidence")).alias("confidence"))


def upsert_links(stored: DataFrame, incoming: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Links after a run, one row per article and company with ``extracted_by, sentiment``.

    A stored link that no model made stays as it is; any other is replaced by what came in. For articles
    in ``forced`` the links that a model made go first.
    """
    kept = stored
    if forced is not None:
        again = forced.select("article_id", F.lit(True).alias("again")).distinct()
        kept = stored.join(again, "article_id", "left").where("again is null or extracted_by <> 'llm'").drop("again")
    a = kept.select("article_id", "company_id", F.struct("extracted_by", "sentiment").alias("old"))
    b = incoming.select("article_id", "company_id", F.struct(F.lit("llm").alias("extracted_by"), "sentiment").alias("new"))
    out = F.when(F.col("new").isNull() | (F.col("old.extracted_by") != "llm"), F.col("old")).otherwise(F.col("new"))
    return a.join(b, ["article_id", "company_id"], "full_outer").select("article_id", "company_id", out.alias("x")).select("article_id", "company_id", "x.*")


def refresh_targets(links: DataFrame, companies: DataFrame, active: DataFrame) -> DataFrame:
    """``company_id`` of linked companies that have an analysis and no active job, once each."""
    able = companies.where("has_analysis").select(F.col("id").alias("company_id"))
    return links.select("company_id").distinct().join(able, "company_id", "left_semi").join(active.select("company_id"), "company_id", "left_anti")


def known_names(companies: DataFrame) -> DataFrame:
    """``name``: names and aliases of all companies, rejected ones too, in lower case."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return companies.select(F.explode(every).alias("name")).where("name is not null").select(F.lower("name").alias("name")).distinct()


def new_entities(entries: DataFrame, companies: DataFrame, most: int = 20) -> DataFrame:
    """Directory entries that are no company yet: ``source_id, position, name, slug``, at most ``most`` a source.

    The name has 2 to 300 characters and a slug, is no known name or alias, and its slug is not stored;
    of entries of a source with one slug the first counts.
    """
    named = entries.withColumn("slug", slug(F.col("name"))).where(F.length("name").between(2, 300) & F.length("slug").between(1, 300))
    open_ = named.join(known_names(companies).select(F.col("name").alias("low")), F.lower("name") == F.col("low"), "left_anti").join(companies.select("slug"), "slug", "left_anti")
    first = open_.groupBy("source_id", "slug").agg(F.min(F.struct("position", "name")).alias("x")).select("source_id", "x.position", "x.name", "slug")
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("position"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def new_company_check(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """``candidate_id, collides_by, company_id``: by slug, else by alias, else by name, case aside; nulls if free."""
    named = candidates.withColumn("low", F.lower(F.trim("name"))).withColumn("own_slug", slug(F.trim("name")))
    least = lambda key, name: companies.select("id", key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.min("id").alias(f"id_{name}"))
    out = named.join(least(F.col("slug"), "own_slug"), "own_slug", "left")
    aliases = companies.select("id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("low")).agg(F.min("id").alias("id_alias"))
    out = out.join(aliases, "low", "left").join(least(F.lower("name"), "low"), "low", "left")
    how = F.when(F.col("id_own_slug").isNotNull(), "slug").when(F.col("id_alias").isNotNull(), "alias").when(F.col("id_low").isNotNull(), "name")
    return out.select("candidate_id", how.alias("collides_by"), F.coalesce("id_own_slug", "id_alias", "id_low").alias("company_id"))


#: What a review can do to a company, and what a company can be.
ACTIONS = ("reject", "unflag", "flag", "keep")
ENTITY_TYPES = ("", "company", "corporate", "research_education", "ecosystem_support")


def review_errors(rows: DataFrame) -> DataFrame:
    """One row with the number of breaches of each rule; a file with any is refused."""
    repeated = rows.groupBy("slug").count().where("count > 1").agg(F.count("*").alias("repeated_slug"))
    bad = lambda c, name: F.count_if(~F.coalesce(c, F.lit(False))).alias(name)
    told = rows.agg(bad(F.col("action").isin(*ACTIONS), "action"), bad(F.col("entity_type").isin(*ENTITY_TYPES), "entity_type"), bad(F.col("local_site").isin("", "0", "1"), "local_site"), bad(F.col("slug") != "", "empty_slug"))
    return told.join(repeated, F.lit(True))  # one row each


def apply_review(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """``slug, action, outcome, changes`` of each reviewed row; ``changes`` maps columns to new values.

    A row meets the company with its slug and exactly its name. Outcomes: not found, name mismatch,
    unchanged, changed. Applying the changes and reviewing again changes nothing.
    """
    columns = ("review_status", "is_map", "entity_type", "postcode", "city", "local_site")
    held = companies.select("slug", F.struct("name", *columns).alias("c"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    wanted = {
        "review_status": F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "flag", "approved"),
        "is_map": F.when(F.col("action") == "unflag", "false").when(F.col("action") == "flag", "true"),
        "entity_type": text("entity_type"),
        "postcode": text("postcode"),
        "city": text("city"),
        "local_site": F.when(F.col("local_site") == "1", "true").when(F.col("local_site") == "0", "false"),
    }
    changed = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull() & ~F.col(f"c.{n}").cast("string").eqNullSafe(v), F.struct(F.lit(n), v)) for n, v in wanted.items()])))
    out = rows.join(held, "slug", "left").withColumn("changes", changed)
    outcome = F.when(F.col("c").isNull(), "not found").when(~F.col("c.name").eqNullSafe(F.col("name")), "name mismatch").when(F.size("changes") == 0, "unchanged").otherwise("changed")
    return out.select("slug", "action", outcome.alias("outcome"), F.when(outcome == "changed", F.col("changes")).alias("changes"))


def review_report(applied: DataFrame) -> DataFrame:
    return applied.groupBy("action", "outcome").agg(F.count("*").alias("n"))


def filled(old: Column, new: Column) -> Column:
    """The old value unless it is missing or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))


def seed_merge(companies: DataFrame, seeds: DataFrame, fields: tuple[str, ...] = ("sector", "website", "company_stage", "spinoff_origin", "ai_analysis")) -> DataFrame:
    """``slug``, the name, the fields and ``outcome``: companies in the file only are added, others get the fields they lack."""
    a = companies.select("slug", F.struct("name", *fields).alias("a"))
    b = seeds.select("slug", F.struct("name", *fields).alias("b"))
    both = a.join(b, "slug", "full_outer")
    values = {f: filled(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields}
    gained = F.lit(False)
    for f, v in values.items():
        gained = gained | ~v.eqNullSafe(F.nullif(F.col(f"a.{f}"), F.lit("")))
    outcome = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "kept").when(gained, "updated").otherwise("skipped")
    return both.select("slug", F.coalesce("a.name", "b.name").alias("name"), *[v.alias(f) for f, v in values.items()], outcome.alias("outcome"))


def merge_analysis(old: DataFrame, new: DataFrame, key: str, fields: list[str], website: Column | None = None) -> DataFrame:
    """The new analysis over the old one, field by field; an empty value keeps the old. ``website`` says whether the new address is sound."""
    both = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key, "left")
    empty = lambda f: F.col(f"n.{f}").isNull() | (F.col(f"n.{f}").cast("string").isin("", "[]"))
    value = lambda f: F.when(empty(f) if website is None or f != "website" else empty(f) | ~F.coalesce(website, F.lit(False)), F.col(f"o.{f}")).otherwise(F.col(f"n.{f}"))
    return both.select(key, *[value(f).alias(f) for f in fields])


def retained(rows: DataFrame, key: str, n: int, time: str, as_of: datetime | None = None, hours: int = 24) -> DataFrame:
    """The newest ``n`` rows of each key and, with ``as_of``, none older than ``hours``."""
    fresh = rows.where(F.col(time) >= moment(as_of - timedelta(hours=hours))) if as_of is not None else rows
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc("id")))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def insert_only(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``stored`` and the first incoming row of each key that it lacks; nothing stored changes."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def clean_columns(rows: DataFrame, columns: list[str], cleaned) -> DataFrame:
    """``rows`` with ``cleaned(column)`` where a column holds ``<`` or ``&``, and ``n_changed``, how many differ."""
    new = {c: F.when(F.col(c).rlike("[<&]"), cleaned(F.col(c))).otherwise(F.col(c)) for c in columns}
    both = rows.select("*", *[v.alias(f"new_{c}") for c, v in new.items()])
    n = F.lit(0)
    for c in columns:
        n = n + (~F.col(c).eqNullSafe(F.col(f"new_{c}"))).cast("int")
    out = both.withColumn("n_changed", n)
    return out.select(*[F.col(f"new_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns], "n_changed")
