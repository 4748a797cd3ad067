"""Entities and articles from directory, portfolio and list pages, by work on page trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import collapse_space, url_identity
from newsloom.functions.times import parse_date
from newsloom.sources.content import resolve_url
from newsloom.sources.fields import ITEM, read_fields
from newsloom.sources.tree import seen_text, subtree

#: Headings that are no entity, texts and parts of links that tell entries from navigation, words of page chrome.
NO_ENTITY = ("calque 1",)
NO_ARTICLE = ("calque 1", "nos startups créées récemment", "santé", "numérique et électronique", "energie et environnement", "chimie et matériaux", "sciences humaines et sociales")
SKIPPED = ("home", "contact", "about", "menu", "search", "back", "next", "previous", "page", "filter", "all", "more", "news", "event", "login", "members", "directory", "members directory", "member directory")
DETAIL_PARTS = ("member-directory/", "startup/", "portfolio/", "/company/", "annuaire/", "nos-startups/")
INDEX_ENDS = ("member-directory", "annuaire", "nos-startups")
NOISE = (
    "start-ups", "suivant", "programme", "startup", "contact", "direction", "recherche", "actualit", "innover", "navigation", "cea-leti", "page", "linkedin", "you tube", "videos", "twitter",
    "facebook", "instagram", "technology research", "culture", "institutionnel", "recherche technologique", "naviguer", "prisonnier", "espaces", "entre 2", "acteur majeur", "que vous soyez",
    "corps de texte", "voir aussi", "documents", "objectifs", "highlights", "innovation days", "appel a candidatures", "hubup", "letidays", "lemaire", "axelle",
)
#: Kinds of organisation by the words that they begin with, the first that fits.
ORGANISATIONS = (
    ("research_education", ("higher education", "research centre", "technology platform")),
    ("ecosystem_support", ("economic development", "bank", "local authority", "cluster")),
    ("corporate", ("large corporation", "mid-cap")),
    ("company", ("sme", "start-up", "startup")),
)
MOST_ENTRIES = 1_000


def page_texts(nodes: Column) -> Column:
    """All texts of a page but scripts and styles, whether readers see them or not."""
    return F.transform(F.filter(nodes, lambda n: (n.tag == "#text") & ~F.get(nodes, n.parent).tag.isin("script", "style")), lambda n: n.text)


def _attribute(node: Column, name: str) -> Column:
    return F.btrim(F.coalesce(F.try_element_at(node.attrs, F.lit(name)), F.lit("")))


def _website(link: Column) -> Column:
    return F.nullif(F.when((link != "") & ~link.startswith("http"), F.concat(F.lit("https://"), link)).otherwise(link), F.lit(""))


def _named_items(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: F.coalesce(F.map_contains_key(n.attrs, "data-name") & F.map_contains_key(n.attrs, "data-description"), F.lit(False)))


def directory_entries(trees: DataFrame) -> DataFrame:
    """``source_id, name, description, website, year`` of the entities of each source's pages ``source_id, page, nodes``.

    Items with data attributes come first, then links to detail pages, and only of sources without either, text blocks of a
    name and a description. The first of each name, case aside, counts; of a source at most ``MOST_ENTRIES``, in that order.
    """
    row = lambda pre, name, description, website, year: F.struct(pre.alias("pre"), name.alias("name"), description.alias("description"), website.alias("website"), year.alias("year"))
    null = F.lit(None).cast("string")
    cut = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit(""))
    item = lambda n: row(n.pre, _attribute(n, "data-name"), cut(_attribute(n, "data-description"), 200), _website(_attribute(n, "data-link")), F.nullif(_attribute(n, "data-year"), F.lit("")))
    items = F.filter(F.transform(_named_items(F.col("nodes")), item), lambda r: (F.length(r["name"]) >= 2) & ~F.lower(r["name"]).isin(*NO_ENTITY))

    anchors = F.filter("nodes", lambda n: (n.tag == "a") & F.coalesce(F.map_contains_key(n.attrs, "href"), F.lit(False)))
    label = lambda n: F.array_join(F.transform(F.filter(subtree(F.col("nodes"), n), lambda x: x.tag == "#text"), lambda x: x.text), "")
    link = lambda n: row(n.pre, label(n), null, n.attrs["href"], null)
    has = lambda c, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(c, p))
    ends = lambda c: F.exists(F.array(*map(F.lit, INDEX_ENDS)), lambda p: F.endswith(F.rtrim(c, F.lit("/")), p))
    fits = lambda r: F.length(r["name"]).between(3, 80) & ~F.lower(r["name"]).isin(*SKIPPED) & ~F.contains(r.website, F.lit("/page/")) & has(F.lower(r.website), DETAIL_PARTS) & ~ends(r.website)
    whole = lambda r: row(r.pre, r["name"], null, F.when(r.website.startswith("http"), r.website), null)
    links = F.transform(F.filter(F.transform(anchors, link), fits), whole)

    pattern = r"(?s)\A([A-Za-z][A-Za-z0-9\-' .]{1,40})[,:]\s+([^\n]{10,300})"
    part = lambda t, i: F.btrim(F.regexp_extract(t, pattern, i))
    blocks = F.transform(page_texts(F.col("nodes")), lambda t, i: row(i, part(t, 1), F.substring(part(t, 2), 1, 150), null, null))
    blocks = F.filter(blocks, lambda r: (r["name"] != "") & ~has(F.lower(r["name"]), NOISE) & F.substring(r.description, 1, 20).rlike(r"\p{L}"))

    each = trees.where("nodes is not null").select("source_id", "page", items.alias("b0"), links.alias("b1"), blocks.alias("b2"))
    names = ("pre", "name", "description", "website", "year")
    marked = lambda i: F.transform(f"b{i}", lambda r: F.struct(F.lit(i).alias("branch"), *[r[c].alias(c) for c in names]))
    rows = each.select("source_id", "page", F.inline(F.concat(*map(marked, range(3)))))
    order = F.struct("branch", "page", "pre")
    first = rows.groupBy("source_id", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "description", "website", "year"), order).alias("e"), F.min(order).alias("order"))
    # by branch first, so what blocks add comes last and goes where the source has anything else
    of_source = Window.partitionBy("source_id").orderBy("order")
    ranked = first.withColumns({"n": F.row_number().over(of_source), "least": F.first("order.branch").over(of_source)})
    ranked = ranked.where((F.col("n") <= MOST_ENTRIES) & ((F.col("order.branch") < 2) | (F.col("least") == 2)))
    return ranked.select("source_id", "e.*")


def directory_facts(trees: DataFrame) -> DataFrame:
    """``page_id, postcode, city, entity_type, is_local`` from the text of member pages; all null where there is no address.

    ``is_local`` holds where the postcode is unknown or of the home department.
    """
    text = collapse_space(F.array_join(page_texts(F.col("nodes")), " "))
    address = F.regexp_extract(text, r"Contact details Adress (.*?) (?:Contact |Website|News |#WeAre|\z)", 1)
    place = lambda i: F.regexp_extract(address, r"\b(\d{5})\s+([A-Za-zÀ-ÿ'’\- ]+?)(?:\s+CEDEX.*)?\z", i)
    # capitals after hyphens and apostrophes as well
    titled = F.regexp_replace(F.initcap(F.regexp_replace(F.btrim(place(2)), "([-'’])", "$1  ")), "([-'’])  ", "$1")
    kind = F.lower(F.regexp_extract(text, r"Type of Organization (.*?) (?:Year founded|Themes)", 1))
    entity = F.coalesce(*[F.when(kind.startswith(w), F.lit(name)) for name, words in ORGANISATIONS for w in words])
    found = trees.select("page_id", F.nullif(place(1), F.lit("")).alias("postcode"), titled.alias("city"), entity.alias("entity_type"))
    known = F.col("postcode").isNotNull()
    return found.select("page_id", "postcode", F.when(known, F.col("city")).alias("city"), F.when(known, F.col("entity_type")).alias("entity_type"), (~known | F.col("postcode").startswith("38")).alias("is_local"))


def portfolio_items(trees: DataFrame) -> DataFrame:
    """``page_id, title, url, external_id, content`` of items with data attributes, the first of each name on a page.

    ``page_id, url, nodes`` come in; an item without an address of its own is found on its page.
    """
    n = F.col("n")
    name, year, link, project = (_attribute(n, f"data-{c}") for c in ("name", "year", "link", "project-url"))
    text = _attribute(n, "data-description")
    url = F.coalesce(F.nullif(project, F.lit("")), _website(link), F.concat("url", F.lit("#"), name))
    items = trees.where("nodes is not null").select("page_id", "url", F.explode(_named_items(F.col("nodes"))).alias("n"))
    rows = items.where((F.length(name) >= 2) & (text != "") & ~F.lower(name).isin(*NO_ARTICLE)).select("page_id", name.alias("name"), F.struct(F.when(year != "", F.concat(name, F.lit(" ("), year, F.lit(")"))).otherwise(name).alias("title"), url.alias("url"), url_identity(F.concat(F.lit("portfolio:"), name)).alias("external_id"), text.alias("content")).alias("a"), n.pre.alias("pre"))
    return rows.groupBy("page_id", "name").agg(F.min_by("a", "pre").alias("a")).select("page_id", "a.*")


def article_cards(trees: DataFrame, part: str = "/article/", least: int = 10, most: int = 500, repeats: bool = False) -> DataFrame:
    """``page_id, title, url, external_id, content, image_url`` of ``<article>`` cards: first link (whose address holds ``part``),
    first heading, first paragraph, image; the first card of each link on a page, before titles are looked at, or all with ``repeats``."""
    nodes = F.col("nodes")
    # each card takes along its own part of the page only
    own = F.transform(F.filter(nodes, lambda n: (n.tag == "article") & ~n.hidden), lambda n: F.struct(n.pre.alias("pre"), subtree(nodes, n).alias("nodes")))
    cards = trees.where("nodes is not null").select("page_id", F.explode(own).alias("card"))
    inside = F.slice("card.nodes", F.lit(2), F.size("card.nodes"))
    first = lambda test: F.get(F.filter(inside, lambda n: F.coalesce(test(n), F.lit(False)) & ~n.hidden), F.lit(0))
    cards = cards.withColumns({"a": first(lambda n: (n.tag == "a") & F.map_contains_key(n.attrs, "href")), "h": first(lambda n: n.tag.isin("h1", "h2", "h3")), "p": first(lambda n: n.tag == "p"), "i": first(lambda n: n.tag == "img")})
    below = lambda n: F.slice("card.nodes", n.pre - F.col("card.pre") + 1, n.end - n.pre + 1)
    told = lambda c: F.nullif(seen_text(below(F.col(c))), F.lit(""))
    image = F.coalesce(F.nullif(F.try_element_at("i.attrs", F.lit("src")), F.lit("")), F.try_element_at("i.attrs", F.lit("data-src")))
    rows = cards.select("page_id", F.col("card.pre").alias("pre"), F.col("a.attrs")["href"].alias("url"), told("h").alias("title"), told("p").alias("content"), image.alias("image_url")).where(F.contains("url", F.lit(part)))
    card = F.struct("title", "content", "image_url")
    one = rows.select("page_id", "url", card.alias("c")) if repeats else rows.groupBy("page_id", "url").agg(F.min_by(card, "pre").alias("c"))
    return one.where(F.length("c.title") >= least).select("page_id", F.substring("c.title", 1, most).alias("title"), "url", url_identity(F.col("url")).alias("external_id"), "c.content", "c.image_url")


def scan_html_items(trees: DataFrame, selectors: DataFrame, limited: bool = True) -> DataFrame:
    """``page_id, scope, item, title, url, external_id, content, author, image_url, published_at`` of list pages ``page_id, scope, url, nodes``.

    ``selectors``: ``scope, item, link, title, content, author, image, date`` (CSS). An item without a title or an http(s) link is left out; a
    date is its ``datetime`` attribute or else its text, an image its ``src`` or else its ``data-src``. ``limited`` leaves out
    items whose values are beyond the limits of ``read_fields``.
    """
    plan = [(ITEM, "item", "text", None), ("link", "link", "attr", "href"), ("image", "image", "attr", "src"), ("later_image", "image", "attr", "data-src"), ("date", "date", "attr", "datetime"), ("date_text", "date", "text", None)]
    plan += [(c, c, "text", None) for c in ("title", "content", "author")]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(s).alias("selector"), F.lit(r).alias("read"), F.lit(a).cast("string").alias("attr")) for f, s, r, a in plan])
    rules = selectors.select("scope", F.inline(rows)).where("selector is not null")
    read = read_fields(trees.select("page_id", "scope", "nodes"), rules, None, limited).where("error is null").join(trees.select("page_id", "scope", F.col("url").alias("page_url")), ["page_id", "scope"])
    of = lambda c: F.try_element_at("values", F.lit(c))
    url = resolve_url(F.col("page_url"), of("link"))
    found = read.select("page_id", "scope", "item", of("title").alias("title"), url.alias("url"), url_identity(url).alias("external_id"), of("content").alias("content"), of("author").alias("author"), F.coalesce(of("image"), of("later_image")).alias("image_url"), F.coalesce(parse_date(of("date"), "UTC"), parse_date(of("date_text"), "UTC")).alias("published_at"))
    return found.where("title is not null and url is not null")
