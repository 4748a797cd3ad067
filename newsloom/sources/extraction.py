"""Articles that recipes read from captured pages.

A recipe names list pages, selectors of their items and fields, the link to the next list page and, by host and path,
templates of the pages that items lead to. Pages are parsed once; next links of every page that a recipe may reach are
read in one pass and then followed as joins of small rows, ten at most. Items, details and structured data are each one
pass over the pages concerned, whatever the number of recipes; each item keeps its errors and each field its origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import kept
from newsloom.functions.text import body_matches_title, content_level, titles_match
from newsloom.functions.times import parse_date
from newsloom.sources.content import resolve_url
from newsloom.sources.fields import ITEM, REMOVE, read_fields
from newsloom.sources.pages import canonical_url
from newsloom.sources.structured import articles_of, jsonld_entities
from newsloom.sources.tree import clean_page, page_trees

MOST_PAGES, MOST_ITEMS = 10, 200
ACCESS = ("forbidden", "robots_denied", "unsafe_url", "login_required", "paywall", "captcha")
_RULE = "struct<selector:string,read:string,attr:string,path:array<string>>"
_SPEC = f"""source_id long, locale string, date_policy struct<source_timezone:string>,
list_pages array<struct<url:string,item_selector:string,fields:map<string,{_RULE}>,pagination:struct<kind:string,selector:string,max_pages:int>>>,
detail_templates array<struct<match:struct<host:string,path_prefix:string>,fields:map<string,{_RULE}>,remove_selectors:array<string>,jsonld_types:array<string>>>"""


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#:]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def _rules(scopes: DataFrame, fields: Column) -> DataFrame:
    """``scope, field, selector, read, attr`` of a map of rules; structured data are read elsewhere."""
    rows = scopes.select("scope", F.explode(fields).alias("field", "rule"))
    return rows.where("rule.read <> 'jsonld'").select("scope", "field", "rule.selector", "rule.read", "rule.attr")


def _stage(code: Column) -> Column:
    return F.when(code.isin(*ACCESS, "redirect_limit"), "transport").when(code.isin("low_quality", "no_evidence"), "quality").otherwise("extraction")


def list_chains(lists: DataFrame, links: DataFrame, pages: DataFrame, rounds: int = MOST_PAGES) -> DataFrame:
    """``recipe_id, list, page, page_id, url, code``: the list pages of each recipe in the order of their next links.

    A page that was not captured ends its chain with ``no_evidence``, one seen before with ``redirect_limit``. ``links`` are
    ``recipe_id, list, page_id, next``; ``pages`` have ``page_id, url``.
    """
    onward = links.select("recipe_id", "list", "page_id", canonical_url(F.col("next")).alias("next"), F.col("next").isNotNull().alias("more"))
    captured = pages.select("page_id", "url")
    now = lists.select("recipe_id", "list", "most", canonical_url(F.col("url")).alias("url"), F.array().cast("array<string>").alias("seen"))
    out = None
    for page in range(rounds):
        allowed = F.coalesce(F.col("url").isNotNull(), F.lit(False))
        met = now.join(captured, "url", "left")
        code = F.when(~allowed, "unsafe_url").when(F.array_contains("seen", F.col("url")), "redirect_limit").when(F.col("page_id").isNull(), "no_evidence")
        here = met.select("recipe_id", "list", "most", F.lit(page).alias("page"), F.when(code.isNull(), F.col("page_id")).alias("page_id"), "url", code.alias("code"), "seen")
        rows = here.select("recipe_id", "list", "page", "page_id", "url", "code")
        out = rows if out is None else out.unionByName(rows)
        went = here.where(F.col("code").isNull() & (F.col("most") > page + 1)).withColumn("seen", F.concat("seen", F.array("url")))
        now = went.join(onward.where("more"), ["recipe_id", "list", "page_id"]).select("recipe_id", "list", "most", F.col("next").alias("url"), "seen")
    return out


def recipe_extract(recipes: DataFrame, pages: DataFrame, limited: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items and page errors of valid recipes (``recipe_id, document``) over ``page_id, url, html``.

    Items: ``recipe_id, list, page, item, outcome, url, title, content, content_level, external_id, published_at,
    published_at_source, author, image_url, language, provenance, errors``; ``outcome`` is ``article``, ``duplicate``, ``rejected`` or, beyond
    the most items of a run, ``dropped``. Page errors: ``recipe_id, list, page, code``. A page counts under its canonical
    address, its first row if there are several. Hosts that a recipe names in its lists and templates are the ones it may reach.
    ``limited`` makes pages and values beyond the limits of ``page_trees`` and ``read_fields`` errors; else they are read whole.
    """
    spec = recipes.select("recipe_id", F.from_json("document", _SPEC).alias("r")).where("r is not null")
    lists = spec.select("recipe_id", F.posexplode("r.list_pages").alias("list", "l"))
    lists = lists.select("recipe_id", "list", F.col("l.url").alias("url"), F.coalesce("l.pagination.max_pages", F.lit(1)).alias("most"), "l", F.concat_ws(":", F.lit("list"), "recipe_id", "list").alias("scope"))
    templates = spec.select("recipe_id", F.posexplode("r.detail_templates").alias("template", "t"))
    templates = templates.select("recipe_id", "template", "t", F.col("t.match.host").alias("host"), F.col("t.match.path_prefix").alias("prefix"), F.concat_ws(":", F.lit("detail"), "recipe_id", "template").alias("scope"))
    hosts = lists.select("recipe_id", _host(canonical_url(F.col("url"))).alias("host")).unionByName(templates.select("recipe_id", "host")).distinct()

    known = pages.select("page_id", canonical_url(F.col("url")).alias("url"), "html").where("url is not null")
    one = known.groupBy("url").agg(F.min("page_id").alias("page_id"))
    trees = kept(page_trees(known.join(one, ["url", "page_id"], "left_semi"), limited=limited))
    captured = trees.select("page_id", "url", _host(F.col("url")).alias("host"), "error")

    # next links of every page on the hosts of a recipe with several list pages
    paged = lists.where("most > 1").withColumn("scope", F.concat(F.lit("next:"), "scope"))
    near = captured.where("error is null").join(hosts, "host").join(paged.select("recipe_id", "list", "scope"), "recipe_id").select("page_id", "url", "recipe_id", "list", "scope")
    next_rules = paged.select("scope", F.lit("next").alias("field"), F.col("l.pagination.selector").alias("selector"), F.lit("attr").alias("read"), F.lit("href").alias("attr"))
    told = read_fields(near.select("page_id", "scope").join(trees.select("page_id", "nodes"), "page_id"), next_rules, limited=limited)
    links = told.select("page_id", "scope", F.col("values")["next"].alias("next")).join(near, ["page_id", "scope"]).select("recipe_id", "list", "page_id", resolve_url(F.col("url"), F.col("next")).alias("next")).where("next is not null")
    longest = min(lists.agg(F.max("most")).first()[0] or 1, MOST_PAGES)
    # small rows, written once, as every round reads them
    chains = kept(list_chains(lists, kept(links) if longest > 1 else links, captured.select("page_id", "url"), longest))

    walked = chains.where("code is null").join(lists.select("recipe_id", "list", "scope"), ["recipe_id", "list"]).join(captured.select("page_id", "error"), "page_id")
    item_rules = _rules(lists, F.col("l.fields")).unionByName(lists.select("scope", F.lit(ITEM).alias("field"), F.col("l.item_selector").alias("selector"), F.lit("text").alias("read"), F.lit(None).cast("string").alias("attr")))
    read = kept(read_fields(walked.where("error is null").select("page_id", "scope").distinct().join(trees.select("page_id", "nodes"), "page_id"), item_rules, None, limited))
    listed = walked.join(read.withColumnRenamed("error", "over"), ["page_id", "scope"], "left")
    page_errors = chains.where("code is not null").select("recipe_id", "list", "page", "code").unionByName(
        listed.groupBy("recipe_id", "list", "page").agg(F.min(F.coalesce("error", "over", F.when(F.col("item").isNull(), "no_evidence"))).alias("code")).where("code is not null")
    )

    items = listed.where("item is not null and over is null").select("recipe_id", "list", "page", "item", "url", "values")
    ordered = Window.partitionBy("recipe_id").orderBy("list", "page", "item")
    value = lambda c: F.try_element_at("values", F.lit(c))
    whole = resolve_url(F.col("url"), value("url"))
    items = items.withColumns({"n": F.row_number().over(ordered), "whole": whole, "link": canonical_url(whole), "title": value("title")})
    allowed = hosts.select("recipe_id", F.col("host").alias("to"), F.lit(True).alias("allowed"))
    items = items.withColumn("to", _host(F.col("link"))).join(allowed, ["recipe_id", "to"], "left")
    refused = F.when(F.col("n") > MOST_ITEMS, "resource_limit").when(F.col("title").isNull() | value("url").isNull(), "missing_fields").when(F.col("allowed").isNull(), "unsafe_url")
    items = items.withColumn("refused", refused)
    again = F.row_number().over(Window.partitionBy("recipe_id", "link", F.col("refused").isNull()).orderBy("n")) > 1
    items = items.withColumn("outcome", F.when(F.col("refused") == "resource_limit", "dropped").when(F.col("refused").isNotNull(), "rejected").when(again, "duplicate").otherwise("article"))

    # the template with the longest prefix; two with one match are an error of the recipe
    articles = items.where("outcome = 'article'")
    fits = articles.select("recipe_id", "link", F.col("to").alias("host")).join(templates.select("recipe_id", "host", "prefix", "template", "scope"), ["recipe_id", "host"]).where(F.startswith(_path(F.col("link")), F.col("prefix")))
    best = fits.groupBy("recipe_id", "link").agg(F.max(F.struct(F.length("prefix").alias("n"), (-F.col("template")).alias("order"), "template", "scope")).alias("t"), F.collect_list(F.length("prefix")).alias("all"))
    best = best.select("recipe_id", "link", "t.template", "t.scope", (F.size(F.filter("all", lambda n: n == F.col("t.n"))) > 1).alias("twice"))
    wanted = best.where("not twice").join(captured.select("page_id", F.col("url").alias("link"), F.col("error").alias("failed")), "link", "left")
    read_by = templates.select("scope", "t")
    plain = lambda c: F.lit(None).cast("string").alias(c)
    content = F.col("t.fields")["content"]
    detail_rules = (
        _rules(read_by, F.col("t.fields"))
        .unionByName(read_by.where(content.isNotNull() & (content.read != "jsonld")).select("scope", F.lit("*noise").alias("field"), content.selector.alias("selector"), F.lit("noise").alias("read"), plain("attr")))
        .unionByName(read_by.select("scope", F.lit(REMOVE).alias("field"), F.explode("t.remove_selectors").alias("selector"), F.lit("remove").alias("read"), plain("attr")))
    )
    visited = wanted.where("page_id is not null and failed is null").select("page_id", "scope", F.col("link").alias("url")).distinct()
    details = read_fields(visited.select("page_id", "scope").join(trees.select("page_id", "nodes"), "page_id"), detail_rules, limited=limited).select("page_id", "scope", "values", F.col("error").alias("over"))
    typed = visited.join(read_by.where("t.jsonld_types is not null").select("scope", F.col("t.jsonld_types").alias("types")), "scope")
    typed = typed.join(read_by.where(F.exists(F.map_values("t.fields"), lambda r: r.read == "jsonld")).select("scope"), "scope", "left_semi")
    entities = jsonld_entities(clean_page(trees.join(typed.select("page_id").distinct(), "page_id", "left_semi")))
    structured = articles_of(typed, entities).select("page_id", "scope", F.col("error").alias("wrong"), F.col("values").alias("named"))

    met = articles.drop("allowed").join(wanted.select("recipe_id", "link", "template", "scope", "page_id", "failed"), ["recipe_id", "link"], "left")
    met = met.join(best.where("twice").select("recipe_id", "link", "twice"), ["recipe_id", "link"], "left").join(details.withColumnRenamed("values", "detail"), ["page_id", "scope"], "left").join(structured, ["page_id", "scope"], "left").join(read_by, "scope", "left")
    none = F.create_map().cast("map<string,string>")
    rules = F.coalesce("t.fields", F.create_map().cast(f"map<string,{_RULE}>"))
    by_path = F.map_filter(F.transform_values(F.map_filter(rules, lambda k, r: r.read == "jsonld"), lambda k, r: F.try_element_at("named", F.array_join(r.path, "."))), lambda k, v: v.isNotNull())
    found = F.map_concat(F.map_filter(F.coalesce("detail", none), lambda k, v: ~F.startswith(k, F.lit("*"))), F.coalesce(by_path, none))
    met = met.withColumn("found", found)
    of = lambda c: F.try_element_at("found", F.lit(c))
    lacks = lambda c: F.map_contains_key(rules, c) & of(c).isNull()
    error = (
        F.when(F.col("twice"), "invalid_schema")
        .when(F.col("template").isNull(), None)
        .when(F.col("page_id").isNull(), "no_evidence")
        .when(F.coalesce("failed", "over", "wrong").isNotNull(), F.coalesce("failed", "over", "wrong"))
        .when(F.try_element_at("detail", F.lit("*noise")).isNotNull(), "low_quality")
        .when(lacks("title") | lacks("content"), "missing_fields")
        .when(of("title").isNotNull() & ~titles_match(F.col("title"), of("title")), "low_quality")
        .when(of("content").isNotNull() & ~body_matches_title(F.col("title"), of("content")), "low_quality")
    )
    met = met.withColumn("error", error)
    used = F.col("template").isNotNull() & F.col("error").isNull()
    taken = F.when(used, F.map_filter("found", lambda k, v: ~k.isin("url", "external_id"))).otherwise(none)
    first = F.map_filter("values", lambda k, v: ~F.map_contains_key(F.col("taken"), k))
    where = lambda kind, place: F.concat(F.lit("doc:"), F.sha2(F.col(kind), 256), *place)
    in_list = lambda k: where("url", (F.lit(":list:"), F.col("list").cast("string"), F.lit(":page:"), F.col("page").cast("string"), F.lit(":item:"), F.col("item").cast("string"), F.lit(":"), k))
    in_detail = lambda k: where("link", (F.lit(":detail:"), F.col("template").cast("string"), F.lit(":"), k))
    method = lambda k: F.when(F.try_element_at(rules, k).read == "jsonld", "jsonld").otherwise("css")
    origin = lambda m, how, at: F.transform(F.map_keys(m), lambda k: F.struct(k.alias("field"), how(k).alias("method"), at(k).alias("locator")))
    met = met.withColumn("taken", taken).withColumn("rest", first)
    # a column of its own, as inside a function over the array the new url would hide the list page's
    met = met.withColumn("provenance", F.array_sort(F.concat(origin(F.col("rest"), lambda k: F.lit("css"), in_list), origin(F.col("taken"), method, in_detail))))
    field = lambda c: F.coalesce(F.try_element_at("taken", F.lit(c)), F.try_element_at("values", F.lit(c)))
    full = used & F.map_contains_key(F.col("taken"), "content") & ~F.coalesce(F.array_join(rules["content"].path, ".") == "description", F.lit(False))
    level = F.when(full, content_level(field("content"))).when(field("content").isNotNull(), "excerpt").otherwise("metadata_only")
    locale = spec.select("recipe_id", F.col("r.locale").alias("language"), F.col("r.date_policy.source_timezone").alias("zone"))
    met = met.join(locale, "recipe_id").withColumn("published_at", parse_date(field("published_at"), F.col("zone")))
    base = F.when(F.map_contains_key(F.col("taken"), "image_url"), F.col("link")).otherwise(F.col("url"))
    image = canonical_url(resolve_url(base, field("image_url")))
    dated = F.when(F.col("published_at").isNull(), "unknown").when(F.map_contains_key(F.col("taken"), "published_at"), "detail").otherwise("list")
    done = met.select(
        "recipe_id", "list", "page", "item", "outcome", F.col("link").alias("url"), "title", field("content").alias("content"), level.alias("content_level"),
        F.coalesce(value("external_id"), F.substring(F.sha2("whole", 256), 1, 32)).alias("external_id"), "published_at", dated.alias("published_at_source"),
        field("author").alias("author"), image.alias("image_url"), "language", "provenance", F.array_compact(F.array("error")).alias("errors"),
    )
    others = items.where("outcome <> 'article'").select("recipe_id", "list", "page", "item", "outcome", F.col("link").alias("url"), "title", F.array_compact(F.array("refused")).alias("errors"))
    return kept(done.unionByName(others, allowMissingColumns=True)), page_errors


def run_report(items: DataFrame, page_errors: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """``recipe_id, status, discovered, extracted, valid, rejected, duplicate, errors``: what came of each run.

    ``errors`` are the distinct ``stage, code``. Under nine tenths of valid items, or under half of the median of the ``recent``
    (``recipe_id, valid``) runs where there are three, is ``low_quality``. With articles a run is ``ready``, ``degraded`` where
    low quality is all that was wrong, else ``partial``; without any it is ``blocked``, ``failed`` or, for want of evidence, ``inconclusive``.
    """
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    counts = items.groupBy("recipe_id").agg(F.count("*").alias("discovered"), is_("article", "duplicate", "rejected").alias("extracted"), is_("article", "duplicate").alias("valid"), is_("rejected").alias("rejected"), is_("duplicate").alias("duplicate"), is_("article").alias("articles"))
    codes = items.select("recipe_id", F.explode("errors").alias("code")).unionByName(page_errors.select("recipe_id", "code")).groupBy("recipe_id").agg(F.collect_set("code").alias("codes"))
    both = counts.join(codes, "recipe_id", "full_outer")
    if recent is not None:
        both = both.join(recent.groupBy("recipe_id").agg(F.median("valid").alias("median"), F.count("*").alias("runs")), "recipe_id", "left")
    else:
        both = both.withColumns({"median": F.lit(None).cast("double"), "runs": F.lit(0)})
    names = ("discovered", "extracted", "valid", "rejected", "duplicate", "articles")
    both = both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})
    poor = ((F.col("extracted") > 0) & (F.col("valid") < F.col("extracted") * 0.9)) | ((F.coalesce("runs", F.lit(0)) >= 3) & (F.col("valid") < F.col("median") * 0.5))
    held = F.coalesce("codes", F.array().cast("array<string>"))
    both = both.withColumn("codes", F.array_sort(F.array_distinct(F.when(F.coalesce(poor, F.lit(False)), F.concat(held, F.array(F.lit("low_quality")))).otherwise(held))))
    any_ = lambda test: F.exists("codes", test)
    with_articles = F.when(F.size("codes") == 0, "ready").when(F.forall("codes", lambda c: c == "low_quality"), "degraded").otherwise("partial")
    without = F.when(any_(lambda c: c.isin(*ACCESS)), "blocked").when(any_(lambda c: c != "no_evidence"), "failed").otherwise("inconclusive")
    errors = F.transform("codes", lambda c: F.struct(_stage(c).alias("stage"), c.alias("code")))
    return both.select("recipe_id", F.when(F.col("articles") > 0, with_articles).otherwise(without).alias("status"), *names[:5], errors.alias("errors"))


def extraction_report(items: DataFrame, page_errors: DataFrame, samples: int = 5, most: int = 1000) -> DataFrame:
    """``run_report`` with ``levels`` (articles by content level), the first ``samples`` articles (``title, url, excerpt, truncated, content_level``)
    and ``samples_truncated``. An excerpt has at most ``most`` characters."""
    articles = items.where("outcome = 'article'")
    content = F.coalesce("content", F.lit(""))
    row = F.struct("list", "page", "item", "title", "url", F.substring(content, 1, most).alias("excerpt"), (F.length(content) > most).alias("truncated"), "content_level")
    first = articles.withColumn("n", F.row_number().over(Window.partitionBy("recipe_id").orderBy("list", "page", "item"))).where(F.col("n") <= samples)
    shown = first.groupBy("recipe_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*[r[c].alias(c) for c in ("title", "url", "excerpt", "truncated", "content_level")])).alias("samples"))
    levels = articles.groupBy("recipe_id", "content_level").count().groupBy("recipe_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_level", "count")))).alias("levels"), F.sum("count").alias("n"))
    told = run_report(items, page_errors).join(levels, "recipe_id", "left").join(shown, "recipe_id", "left")
    return told.withColumn("samples_truncated", F.coalesce(F.col("n") > samples, F.lit(False))).drop("n")


def holdout_check(base: DataFrame, candidate: DataFrame, pages: DataFrame) -> DataFrame:
    """``recipe_id, status, reason, details``: whether a candidate's recipe reads the same pages as well as it must.

    ``base`` and ``candidate`` have ``recipe_id, document``. The base recipe without templates gives the inventory: under three
    articles, a run that is not ready, or an article whose page was not captured is ``inconclusive``. The candidate has to read exactly
    these articles, each in full from the page that it leads to by the template that fits; each of its lists and templates has to be used,
    lists with next links beyond their first page. All recipes are judged at once.
    """
    spec = F.from_json("document", _SPEC)
    bare = base.select("recipe_id", F.to_json(spec.dropFields("detail_templates")).alias("document"))
    inventory, inventory_errors = recipe_extract(bare, pages)
    found, found_errors = recipe_extract(candidate, pages)
    captured = pages.select(canonical_url(F.col("url")).alias("url")).distinct().withColumn("captured", F.lit(True))
    expected = inventory.where("outcome = 'article'").select("recipe_id", "url").join(captured, "url", "left")
    first = expected.groupBy("recipe_id").agg(F.count("*").alias("details"), F.bool_and(F.coalesce("captured", F.lit(False))).alias("held"))
    of_base = run_report(inventory, inventory_errors).select("recipe_id", F.col("status").alias("base_status"))
    of_candidate = run_report(found, found_errors).select("recipe_id", F.col("status").alias("own_status"))

    articles = found.where("outcome = 'article'").join(captured, "url", "left")
    origin = F.get(F.filter("provenance", lambda p: p.field == "content"), F.lit(0)).locator
    template = F.regexp_extract(origin, r":detail:(\d+):content\z", 1)
    own = F.startswith(origin, F.concat(F.lit("doc:"), F.sha2("url", 256), F.lit(":detail:")))
    judged = articles.select("recipe_id", "url", "list", "page", (F.col("captured") & (F.col("content_level") == "full")).alias("full"), F.coalesce(own, F.lit(False)).alias("own"), F.nullif(template, F.lit("")).cast("int").alias("template"))
    each = judged.groupBy("recipe_id").agg(F.bool_and(F.coalesce("full", F.lit(False))).alias("full"), F.bool_and("own").alias("own"), F.count_distinct("template").alias("templates"))
    same = expected.select("recipe_id", "url").withColumn("e", F.lit(True)).join(judged.select("recipe_id", "url").withColumn("f", F.lit(True)), ["recipe_id", "url"], "full_outer").groupBy("recipe_id").agg(F.bool_and(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("same"))
    lists = candidate.select("recipe_id", F.posexplode(spec["list_pages"]).alias("list", "l")).select("recipe_id", "list", F.col("l.pagination").isNotNull().alias("paged"))
    used = lists.join(judged.groupBy("recipe_id", "list").agg(F.max("page").alias("last")), ["recipe_id", "list"], "left").groupBy("recipe_id").agg(F.bool_and(F.col("last").isNotNull() & (~F.col("paged") | (F.col("last") >= 1))).alias("lists"))
    wanted = candidate.select("recipe_id", F.coalesce(F.size(spec["detail_templates"]), F.lit(0)).alias("n_templates"))
    both = wanted
    for other in (of_base, of_candidate, first, each, same, used):
        both = both.join(other, "recipe_id", "left")
    lacking = (F.coalesce("base_status", F.lit("")) != "ready") | (F.coalesce("details", F.lit(0)) < 3) | ~F.coalesce("held", F.lit(False))
    reason = (
        F.when(lacking, "insufficient_independent_details")
        .when(~F.coalesce("full", F.lit(False)), "detail_quality_failed")
        .when(~F.coalesce("own", F.lit(False)), "detail_provenance_failed")
        .when((F.coalesce("own_status", F.lit("")) != "ready") | ~F.coalesce("same", F.lit(False)), "inventory_or_template_coverage_failed")
        .when(~F.coalesce("lists", F.lit(False)), "insufficient_list_coverage")
        .when(F.coalesce("templates", F.lit(0)) != F.greatest("n_templates", F.lit(0)), "insufficient_template_coverage")
        .otherwise("controlled_holdout_checks_passed")
    )
    status = F.when(reason.startswith("insufficient"), "inconclusive").when(reason == "controlled_holdout_checks_passed", "passed").otherwise("failed")
    return both.select("recipe_id", status.alias("status"), reason.alias("reason"), F.coalesce("details", F.lit(0)).alias("details"))
