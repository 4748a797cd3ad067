"""Extraction recipes: their contract, checked key by key with a path for each failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.documents import Rule, broken_rules, duplicate_keys, json_nodes

RECIPE = "crawl_schema"
#: Fields of an article, what rules may read, and the limits of a recipe.
FIELDS = ("title", "url", "content", "external_id", "published_at", "author", "image_url")
READS = ("text", "paragraphs", "attr")
ATTRIBUTES = ("href", "src", "datetime", "content", "title", "id")
JSONLD_TYPES = ("Article", "NewsArticle", "Event")
JSONLD_PATHS = {
    "title": ('["headline"]', '["name"]'),
    "url": ('["url"]', '["@id"]'),
    "content": ('["articleBody"]', '["description"]'),
    "external_id": ('["@id"]', '["url"]'),
    "published_at": ('["datePublished"]',),
    "author": ('["author", "name"]',),
    "image_url": ('["image"]', '["image", "url"]'),
}
FEED_KEYS = {"title": ("title",), "url": ("link",), "external_id": ("id", "link"), "content": ("content", "summary"), "published_at": ("published", "updated"), "author": ("author",)}
MOST_BYTES, MOST_DEPTH, MOST_NODES, MOST_FIELDS, MOST_SELECTORS = 65_536, 12, 2_048, 64, 128

_URL = r"\A(?i:https?)://(?:[^/?#@\s\\:\[\]]+|\[[0-9a-fA-F:.]+\])(?::(?!0*(?:[/?#]|\z))0*(?:[0-5]?\d{1,4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5]))?(?:[/?#][^\s\\]*)?\z"


def _object(pattern: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> Rule:
    return Rule(pattern, "object", "invalid_type", required, optional, key_code="invalid_fields")


def _text(pattern: str, most: int, regex: str | None = None, regex_code: str | None = None) -> Rule:
    return Rule(pattern, "text", "invalid_text", least=1, most=most, plain=True, regex=regex, regex_code=regex_code)


def _choice(pattern: str, *choices: str) -> Rule:
    return Rule(pattern, "choice", "unsupported_value", choices=choices)


def _selector(pattern: str) -> Rule:
    return Rule(pattern, "selector", "invalid_text", least=1, most=256, plain=True, regex_code="invalid_selector")


def _whole(pattern: str, code: str, least: int, most: int) -> Rule:
    return Rule(pattern, "integer", code, least=least, most=most)


def _field_rules(pattern: str, required: tuple[str, ...]) -> list[Rule]:
    rules = [_object(pattern, required, FIELDS)]
    for name in FIELDS:
        at = f"{pattern}.{name}"
        rules += [_object(at, ("selector", "read"), ("attr",)), _selector(f"{at}.selector"), _choice(f"{at}.read", *READS), _choice(f"{at}.attr", *ATTRIBUTES)]
        own = f"{at}<jsonld>"
        rules += [_object(own, ("read", "path")), Rule(f"{own}.path", "choice", "invalid_jsonld_path", choices=JSONLD_PATHS[name])]
    return rules


_SHARED = (
    _whole("$.format_version", "invalid_integer", 1, 1),
    _whole("$.source_id", "invalid_integer", 1, 2**31 - 1),
    _choice("$.output_contract", "article.v1"),
    _choice("$.target_kind", "news"),
    _choice("$.transport", "http"),
    _choice("$.identity_policy", "legacy-compatible-url-v1"),
    _choice("$.extractor", "html", "rss"),
    _text("$.locale", 35, r"\A(?:unknown|[a-z]{2,3}(?:-[A-Za-z0-9]{2,8}){0,3})\z", "invalid_language"),
    Rule("$.detail_templates", "array", "invalid_array", least=0, most=8),
    _object("$.detail_templates[*]", ("match", "fields"), ("remove_selectors", "jsonld_types")),
    Rule("$.detail_templates[*].jsonld_types", "array", "invalid_array", least=1, most=3),
    _choice("$.detail_templates[*].jsonld_types[*]", *JSONLD_TYPES),
    _object("$.detail_templates[*].match", ("host", "path_prefix")),
    _text("$.detail_templates[*].match.host", 253, r"\A[a-z0-9]+(?:[.-][a-z0-9]+)*\z", "invalid_host"),
    _text("$.detail_templates[*].match.path_prefix", 1000, r"\A/(?!/)[^?#\\]*\z", "invalid_path"),
    *_field_rules("$.detail_templates[*].fields", ()),
    Rule("$.detail_templates[*].remove_selectors", "array", "invalid_array", least=0, most=16),
    _selector("$.detail_templates[*].remove_selectors[*]"),
    _object("$.date_policy", ("source_timezone",)),
    Rule("$.date_policy.source_timezone", "zone", "invalid_text", least=1, most=100, plain=True, regex_code="invalid_timezone"),
)
_NEEDED = ("format_version", "output_contract", "target_kind", "source_id", "locale", "transport", "identity_policy")
_OPTIONAL = ("detail_templates", "date_policy", "extractor")
RECIPE_RULES: dict[str, tuple[Rule, ...]] = {
    "html": (
        _object("$", (*_NEEDED, "list_pages"), _OPTIONAL),
        Rule("$.list_pages", "array", "invalid_array", least=1, most=4),
        _object("$.list_pages[*]", ("url", "item_selector", "fields"), ("pagination",)),
        _text("$.list_pages[*].url", 1000, _URL, "invalid_url"),
        _selector("$.list_pages[*].item_selector"),
        *_field_rules("$.list_pages[*].fields", ("title", "url")),
        _object("$.list_pages[*].pagination", ("kind", "selector", "max_pages")),
        _choice("$.list_pages[*].pagination.kind", "next_link"),
        _whole("$.list_pages[*].pagination.max_pages", "invalid_integer", 1, 10),
        _selector("$.list_pages[*].pagination.selector"),
        *_SHARED,
    ),
    "rss": (
        _object("$", (*_NEEDED, "feed"), _OPTIONAL),
        _object("$.feed", ("url", "fields")),
        _text("$.feed.url", 1000, _URL, "invalid_url"),
        _object("$.feed.fields", ("title", "url"), tuple(FEED_KEYS)),
        *[_choice(f"$.feed.fields.{k}", *v) for k, v in FEED_KEYS.items()],
        *_SHARED,
    ),
}


def recipe_failures(documents: DataFrame) -> DataFrame:
    """``id, code, path`` of each failure of the recipes ``id, nodes, size`` (bytes)."""
    nodes = F.col("nodes")
    value = lambda path: F.get(F.filter(nodes, lambda n: n.path == path), F.lit(0)).text
    # rules of templates with types of structured data may read that instead of a selector
    typed = F.transform(F.filter(nodes, lambda n: n.pattern == "$.detail_templates[*].jsonld_types"), lambda n: n.parent)
    below = lambda n, i: F.regexp_extract(n.path, r"\A(\$\.detail_templates\[\d+\]\.fields\.[^.\[]+)" + i, 1)
    reads = F.filter(nodes, lambda n: (n.key == "read") & (n.text == "jsonld") & n.pattern.rlike(r"\A\$\.detail_templates\[\*\]\.fields\.[^.]+\.read\z"))
    template = lambda path: F.get(F.filter(nodes, lambda n: n.path == F.regexp_extract(path, r"\A(\$\.detail_templates\[\d+\])", 1)), F.lit(0)).at
    switched = F.transform(F.filter(reads, lambda n: F.array_contains(typed, template(n.path))), lambda n: below(n, r"\.read\z"))
    held = documents.select("id", "size", F.when(value("$.extractor") == "rss", "rss").otherwise("html").alias("contract"), nodes.alias("nodes"), switched.alias("switched"))
    own = lambda n: F.array_contains(F.col("switched"), below(n, r"(?:\.|\z)"))
    pattern = lambda n: F.when(own(n), F.regexp_replace(n.pattern, r"(\.fields\.[^.]+)", "$1<jsonld>")).otherwise(n.pattern)
    names = ("at", "parent", "depth", "key", "path", "kind", "text", "keys", "size")
    told = held.withColumn("nodes", F.transform("nodes", lambda n: F.struct(*[n[x].alias(x) for x in names], pattern(n).alias("pattern"))))
    broken = broken_rules(told, RECIPE_RULES)

    each = F.transform("nodes", lambda n: F.struct(n.path.alias("path"), n.pattern.alias("pattern"), n["keys"].alias("keys"), n.text.alias("text")))
    rules = F.filter(each, lambda n: n.pattern.rlike(r"\A\$\.(?:list_pages|detail_templates)\[\*\]\.fields\.[a-z_]+\z"))
    reading = lambda n: F.get(F.filter(each, lambda m: m.path == F.concat(n.path, F.lit(".read"))), F.lit(0)).text
    has = lambda n, k: F.array_contains(n["keys"], k)
    failure = lambda code, path: F.struct(F.lit(code).alias("code"), path.alias("path"))
    lacking = F.transform(F.filter(rules, lambda n: (reading(n) == "attr") & ~has(n, "attr")), lambda n: failure("unsupported_value", F.concat(n.path, F.lit(".attr"))))
    needless = F.transform(F.filter(rules, lambda n: has(n, "attr") & (reading(n) != "attr")), lambda n: failure("invalid_fields", n.path))
    empty = F.transform(F.filter(each, lambda n: (n.pattern == "$.detail_templates[*].fields") & (F.size(n["keys"]) == 0)), lambda n: failure("invalid_fields", n.path))
    count = lambda regex: F.size(F.filter(each, lambda n: n.pattern.rlike(regex)))
    n_fields = count(r"\A\$\.(?:list_pages\[\*\]|detail_templates\[\*\]|feed)\.fields\.[^.\[]+\z")
    n_selectors = count(r"\A\$\.(?:list_pages|detail_templates)\[\*\]\.(?:fields\.[^.\[]+|remove_selectors\[\*\]|item_selector|pagination)\z")
    over = (F.col("size") > MOST_BYTES) | (F.size("nodes") > MOST_NODES) | (F.array_max(F.transform("nodes", lambda n: n.depth)) > MOST_DEPTH) | (n_fields > MOST_FIELDS) | (n_selectors > MOST_SELECTORS)
    whole = F.when(over, F.array(failure("limit_exceeded", F.lit("$")))).otherwise(F.array().cast("array<struct<code:string,path:string>>"))
    across = told.select("id", F.explode(F.concat(lacking, needless, empty, whole)).alias("f")).select("id", "f.code", "f.path")
    return broken.unionByName(across)


def recipe_check(recipes: DataFrame) -> DataFrame:
    """``recipe_id, code, path`` of each failure of ``recipe_id, document`` (JSON text); a valid recipe has no rows."""
    read = recipes.select(F.col("recipe_id").alias("id"), F.octet_length("document").alias("size"), json_nodes("document").alias("nodes"))
    whole = read.where("nodes is null").select("id", F.lit("invalid_json").alias("code"), F.lit("$").alias("path"))
    twice = read.select("id", F.explode(duplicate_keys(F.col("nodes"))).alias("path")).select("id", F.lit("duplicate_key").alias("code"), "path")
    found = whole.unionByName(twice).unionByName(recipe_failures(read.where("nodes is not null")))
    return found.select(F.col("id").alias("recipe_id"), "code", "path").distinct()
