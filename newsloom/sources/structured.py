"""Articles from the structured data (JSON-LD) of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.content import resolve_url
from newsloom.sources.documents import json_nodes
from newsloom.sources.recipes import JSONLD_PATHS, JSONLD_TYPES

MOST_NODES, MOST_DEPTH = 4_096, 32
#: Entities stand alone, in a list, or in graphs of one of these, however deep.
_ENTITY = r"\A\$(?:\[\d+\])?(?:\.@graph\[\d+\])*\z"


def jsonld_entities(clean: DataFrame, types: tuple[str, ...] = JSONLD_TYPES) -> DataFrame:
    """``page_id, script, error, entities`` of each JSON-LD script of ``page_id, structured``.

    An entity is an object of one of the ``types`` with its ``values`` by path (``author.name``), ``keys`` and ``kinds``. A script
    that is no JSON or repeats a key is an ``invalid_article``, one over the limits a ``resource_limit``.
    """
    scripts = clean.select("page_id", F.posexplode("structured").alias("script", "body")).select("page_id", "script", json_nodes("body").alias("nodes"))
    n = F.col("nodes")
    twice = F.exists(n, lambda x: F.size(x["keys"]) > F.size(F.array_distinct(x["keys"])))
    over = (F.size(n) > MOST_NODES) | F.exists(n, lambda x: x.depth > MOST_DEPTH)
    error = F.when(n.isNull() | twice, "invalid_article").when(over, "resource_limit")
    below = lambda e, path: F.get(F.filter(n, lambda x: x.path == F.concat(e.path, F.lit("." + path))), F.lit(0))
    kind_texts = lambda e: F.filter(n, lambda x: (x.kind == "text") & ((x.path == F.concat(e.path, F.lit(".@type"))) | F.startswith(x.path, F.concat(e.path, F.lit(".@type[")))))
    wanted = lambda e: F.exists(kind_texts(e), lambda x: x.text.isin(*types))
    paths = sorted({p.strip("[]").replace('"', "").replace(", ", ".") for several in JSONLD_PATHS.values() for p in several})
    value = lambda e, path: F.when(below(e, path).kind == "text", below(e, path).text)
    told = lambda e: F.struct(F.map_from_entries(F.array(*[F.struct(F.lit(p), value(e, p)) for p in paths])).alias("values"), e["keys"].alias("keys"), F.transform(kind_texts(e), lambda x: x.text).alias("kinds"), below(e, "isAccessibleForFree").text.alias("free"))
    entities = F.transform(F.filter(n, lambda e: (e.kind == "object") & e.path.rlike(_ENTITY) & wanted(e)), told)
    return scripts.select("page_id", "script", error.alias("error"), F.when(error.isNull(), entities).alias("entities"))


def articles_of(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """``page_id, scope, error, values`` (by path) of the one entity of ``types`` that is about its page.

    ``pages`` have ``page_id, scope, url, types``, so that several recipes may read one page. That entity is the one whose ``url``,
    or else ``@id``, leads to the page; where none does, the only one, if it has neither. None or several are an
    ``invalid_article``; one that is not free to read is a ``paywall``.
    """
    flat = pages.join(entities.select("page_id", "error", F.explode_outer("entities").alias("e")), "page_id", "left")
    flat = flat.withColumn("e", F.when(F.arrays_overlap("e.kinds", "types"), F.col("e")))
    named = F.when(F.array_contains(F.col("e.keys"), "url"), F.col("e.values")["url"]).otherwise(F.col("e.values")["@id"])
    bare: Column = F.regexp_replace(resolve_url(F.col("url"), named), "#.*$", "")
    unnamed = ~F.array_contains(F.col("e.keys"), "url") & ~F.array_contains(F.col("e.keys"), "@id")
    marked = flat.select("page_id", "scope", "error", "e", (bare == F.col("url")).alias("matched"), unnamed.alias("unnamed"))
    by_page = marked.groupBy("page_id", "scope").agg(
        F.min("error").alias("error"),
        F.count("e").alias("n"),
        F.count_if("matched").alias("n_matched"),
        F.bool_or("unnamed").alias("unnamed"),
        F.coalesce(F.first(F.when(F.col("matched"), F.col("e")), ignorenulls=True), F.first("e", ignorenulls=True)).alias("e"),
    )
    one = (F.col("n_matched") == 1) | ((F.col("n_matched") == 0) & (F.col("n") == 1) & F.col("unnamed"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(one, F.lit(False)), "invalid_article").when(F.col("e.free").isin("false", "False"), "paywall")
    told = by_page.select("page_id", "scope", error.alias("error"), F.transform_values(F.col("e.values"), lambda k, v: F.nullif(F.btrim(v), F.lit(""))).alias("values"))
    return told.withColumn("values", F.when(F.col("error").isNull(), F.map_filter("values", lambda k, v: v.isNotNull())))


def jsonld_article(pages: DataFrame, clean: DataFrame, paths: dict[str, str], types: tuple[str, ...] = JSONLD_TYPES) -> DataFrame:
    """``page_id, error, values``: the fields that ``paths`` name, of the article that a page's (``page_id, url``) structured data hold."""
    asked = pages.select("page_id", "url", F.lit("").alias("scope"), F.array(*map(F.lit, types)).alias("types")).join(clean.where("structured is not null").select("page_id"), "page_id", "left_semi")
    found = articles_of(asked, jsonld_entities(clean, types))
    taken = F.array(*[F.struct(F.lit(k).alias("k"), F.col("values")[p].alias("v")) for k, p in paths.items()])
    return found.select("page_id", "error", F.when(F.col("error").isNull(), F.map_from_entries(F.filter(taken, lambda x: x.v.isNotNull()))).alias("values"))
