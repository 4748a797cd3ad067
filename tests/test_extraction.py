"""Page trees, field rules, JSON contracts, structured data and recipes on made cases."""

import datetime
import hashlib
import json

import pytest
from newsloom.operators.outputs import validate_model_output
from newsloom.sources import extraction, fields, recipes, structured, tree


def pages_of(spark, *bodies):
    return spark.createDataFrame([(i, f"https://e.org/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_implied_ends():
    def shape(body):
        nodes = tree._Reader().read(body)
        return [(n[4], n[6] or "", n[2], n[1]) for n in nodes]

    assert shape("<p>a<p>b</p></div>c") == [("#document", "", None, 5), ("p", "", 0, 2), ("#text", "a", 1, 2), ("p", "", 0, 4), ("#text", "b", 3, 4), ("#text", "c", 0, 5)]
    assert [n[0] for n in shape("<ul><li>a<ul><li>b</ul><li>c</ul>")] == ["#document", "ul", "li", "#text", "ul", "li", "#text", "li", "#text"]
    assert [(n[0], n[2]) for n in shape("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>e")][-4:] == [("td", 10), ("#text", 11), ("#text", 8), ("#text", 0)]
    assert [n[0] for n in shape('<script>var t="</p><p>";</script><br>x<img src=a>')] == ["#document", "script", "#text", "br", "#text", "img"]
    assert shape("") == [("#document", "", None, 0)]
    assert [n[1] for n in shape("a&amp;b &lt;p&gt; <!-- no -->c")] == ["", "a&b <p>", "c"]


def test_clean_page(spark):
    bodies = [
        "<title>T &amp; t</title><nav>menu</nav><p>one <b>two</b></p><div style='display : none'>no</div><p hidden>no</p><div aria-hidden=true><p>no</p></div><a href='/x'>go  on</a><p> </p>",
        "<form><input type=PASSWORD></form>",
        "<div class='a paywall b'>x</div>",
        "<p id=challenge-form>x</p>",
        "<div>" * 70,
        "<p>a" + "x" * (512 * 1024),
        None,
        "<br>" * 20_001,
        "<script type='application/ld+json'>{\"a\": 1}</script><script type='application/ld+json'>[]</script>",
    ]
    got = {r.page_id: r for r in tree.clean_page(tree.page_trees(pages_of(spark, *bodies).repartition(3))).collect()}
    assert (got[0].title, got[0].paragraphs, got[0].text) == ("T & t", ["one two"], "T & t one two go on")
    assert [tuple(x) for x in got[0].links] == [("/x", "go on")]
    assert [got[i].error for i in range(8)] == [None, "login_required", "paywall", "captcha", "resource_limit", "resource_limit", None, "resource_limit"]
    assert got[1].text is None and got[6].text == "" and got[6].title is None
    assert got[8].structured == ['{"a": 1}', "[]"]


@pytest.mark.parametrize(
    "selector, steps",
    [("p", 1), ("div.a > p b", 3), ("#x.y[href^='/a b']", 1), ("* > *", 2), (" a ", 1), ("a[b]", 1), ("a,b", None), ("a:b", None), ("a + b", None), ("", None), ("> a", None), ("a >", None), ("a\\b", None), ("a[b", None), (" ".join("abcdefgh"), 8), (" ".join("abcdefghi"), None)],
)
def test_selectors(selector, steps):
    found = fields.selector_steps(selector)
    assert (found and len(found)) == steps


def test_read_fields(spark):
    body = """<main id=m><div class='card x'><h2><a href='/1' title=' t '>One</a></h2><p>First.</p><p>More.</p></div>
    <div class=card><div class=in><h2><a href='/2'>Two</a></h2></div><p class='note'>Gone.<p>Stays.</div><div class=card><span>none</span></div></main><h2>out</h2>"""
    trees = tree.page_trees(pages_of(spark, body, "<p>no card</p>")).select("page_id", "nodes")
    rules = [
        ("list", fields.ITEM, "#m > .card", "text", None),
        ("list", "title", "h2 a", "text", None),
        ("list", "direct", "div.card > h2", "text", None),
        ("list", "href", "a[href^='/']", "attr", "href"),
        ("list", "tip", "a[title]", "attr", "title"),
        ("list", "body", "div", "paragraphs", None),
        ("page", "all", "main", "paragraphs", None),
        ("page", "last", "h2", "text", None),
        ("page", fields.REMOVE, "p.note", "remove", None),
        ("page", fields.REMOVE, "main div.in", "remove", None),
        ("page", "in", ".in h2", "text", None),
        ("page", "noise", "#m", "noise", None),
    ]
    table = spark.createDataFrame(rules, "scope string, field string, selector string, read string, attr string")
    both = trees.crossJoin(spark.createDataFrame([("list",), ("page",)], "scope string"))
    got = {(r.page_id, r.scope, r.item): r["values"] for r in fields.read_fields(both, table).collect()}
    assert got == {
        (0, "list", 0): {"title": "One", "direct": "One", "href": "/1", "tip": "t"},
        (0, "list", 1): {"title": "Two", "href": "/2", "body": "Two"},
        (0, "list", 2): {},
        (0, "page", 0): {"all": "First.\n\nMore.\n\nStays.", "last": "One"},
        (1, "page", 0): {},
    }
    many = tree.page_trees(pages_of(spark, "<i>a</i>" * 201)).select("page_id", "nodes").selectExpr("*", "'list' as scope")
    over = spark.createDataFrame([("list", fields.ITEM, "i", "text", None)], table.schema)
    assert {r.error for r in fields.read_fields(many, over).collect()} == {"resource_limit"}
    assert fields.read_fields(many.limit(0), over).count() == 0


SENTIMENT = {"sentiment": "positive", "score": 0.5, "reason": "x"}
COMPANY = {"name": "A", "mentions": 1, "is_primary": True}
ANALYSIS = dict.fromkeys(("overview", "founders", "spinoff_source", "core_tech", "cn_competitor_names", "business_status", "recommendation_reason", "recommendation", "website"), "") | {"competitors": []}
OUTPUTS = [
    ("sentiment", json.dumps(SENTIMENT), []),
    ("sentiment", f" ```json\n{json.dumps(SENTIMENT)}\n``` ", []),
    ("sentiment", '{"sentiment":"positive","score":1,"reason":"","score":1}', ["duplicate_key $"]),
    ("sentiment", json.dumps(SENTIMENT | {"score": 1.01}), ["range $.score"]),
    ("sentiment", json.dumps(SENTIMENT | {"score": True, "sentiment": None, "more": 1}), ["keys $", "range $.score", "choice $.sentiment"]),
    ("sentiment", '{"sentiment":"positive","score":NaN,"reason":"x"}', ["json $"]),
    ("sentiment", '{"sentiment":"positive","score":1e999,"reason":"x"}', ["range $.score"]),
    ("sentiment", "[1]", ["type $"]),
    ("sentiment", "nope", ["json $"]),
    ("sentiment", " \n", ["empty $"]),
    ("sentiment", None, ["empty $"]),
    ("sentiment", "x" * 200_001, ["size $"]),
    ("translate", "free {text}", []),
    ("ner", json.dumps({"companies": [COMPANY, COMPANY | {"company_stage": "mature", "location": {"in_isere": False, "city": None}}]}), []),
    ("ner", json.dumps({"companies": [COMPANY | {"name": " ", "mentions": 1.0, "location": {"city": "x" * 121}, "company_stage": "old"}]}), ["choice $.companies[0].company_stage", "keys $.companies[0].location", "text $.companies[0].location.city", "range $.companies[0].mentions", "text $.companies[0].name"]),
    ("ner", json.dumps({"companies": [COMPANY] * 101}), ["size $.companies"]),
    ("classify", json.dumps({"categories": [{"category": "ai", "confidence": 1}], "highlights": ["investment"], "event_date": "2026-02-28"}), []),
    ("classify", json.dumps({"categories": [{"category": "a", "confidence": 2}], "highlights": ["x"] * 5, "event_date": "2026-02-30"}), ["choice $.categories[0].category", "range $.categories[0].confidence", "date $.event_date", "size $.highlights"] + [f"choice $.highlights[{i}]" for i in range(5)]),
    ("company_analysis", json.dumps(ANALYSIS), []),
    ("company_analysis", json.dumps(ANALYSIS | {"website": "w" * 501, "recommendation": "buy", "competitors": [{"dimension": 1, "company": "", "cn_competitor": ""}]}), ["text $.competitors[0].dimension", "choice $.recommendation", "text $.website"]),
]


def test_model_outputs(spark):
    rows = [(i, task, text) for i, (task, text, _) in enumerate(OUTPUTS)]
    got = validate_model_output(spark.createDataFrame(rows, "output_id long, task string, text string").repartition(3)).collect()
    for r in got:
        assert [f"{f.code} {f.path}" for f in r.failures] == OUTPUTS[r.output_id][2], OUTPUTS[r.output_id]
        assert r.valid == (not OUTPUTS[r.output_id][2])
    assert len(got) == len(rows)


def recipe(**changes):
    made = {
        "format_version": 1, "output_contract": "article.v1", "target_kind": "news", "source_id": 7, "locale": "fr", "transport": "http", "identity_policy": "legacy-compatible-url-v1",
        "list_pages": [{"url": "https://e.org/list", "item_selector": "article", "fields": {"title": {"selector": "h2 a", "read": "text"}, "url": {"selector": "h2 a", "read": "attr", "attr": "href"}}, "pagination": {"kind": "next_link", "selector": "a.next", "max_pages": 3}}],
        "detail_templates": [{"match": {"host": "e.org", "path_prefix": "/n/"}, "fields": {"title": {"selector": "h1", "read": "text"}, "content": {"selector": "main", "read": "paragraphs"}, "published_at": {"selector": "time", "read": "attr", "attr": "datetime"}}, "remove_selectors": ["aside"]}],
        "date_policy": {"source_timezone": "Europe/Paris"},
    }
    for path, value in changes.items():
        at, *names = made, *path.split("__")
        for name in names[:-1]:
            at = at[int(name) if name.isdigit() else name]
        last = int(names[-1]) if names[-1].isdigit() else names[-1]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return made


JSONLD = {"match": {"host": "e.org", "path_prefix": "/"}, "jsonld_types": ["Article"], "fields": {"title": {"read": "jsonld", "path": ["headline"]}, "author": {"read": "jsonld", "path": ["author", "name"]}}}
RECIPES = [
    (recipe(), []),
    (recipe(detail_templates=[JSONLD]), []),
    (recipe(detail_templates=[{k: v for k, v in JSONLD.items() if k != "jsonld_types"}]), ["invalid_fields $.detail_templates[0].fields.author", "unsupported_value $.detail_templates[0].fields.author.read", "invalid_fields $.detail_templates[0].fields.title", "unsupported_value $.detail_templates[0].fields.title.read"]),
    (recipe(detail_templates=[JSONLD | {"fields": {"title": {"read": "jsonld", "path": ["name", "x"]}}, "jsonld_types": ["Thing"]}]), ["invalid_jsonld_path $.detail_templates[0].fields.title.path", "unsupported_value $.detail_templates[0].jsonld_types[0]"]),
    (recipe(detail_templates=[JSONLD | {"fields": {}}]), ["invalid_fields $.detail_templates[0].fields"]),
    (recipe(source_id=0, locale="FR", more=1), ["invalid_fields $", "invalid_language $.locale", "invalid_integer $.source_id"]),
    (recipe(source_id=True, transport="ftp", locale=" "), ["invalid_text $.locale", "invalid_integer $.source_id", "unsupported_value $.transport"]),
    (recipe(list_pages=[]), ["invalid_array $.list_pages"]),
    (recipe(list_pages=None), ["invalid_fields $"]),
    (recipe(list_pages__0__url="https://u:p@e.org/"), ["invalid_url $.list_pages[0].url"]),
    (recipe(list_pages__0__url="https://e.org:0/"), ["invalid_url $.list_pages[0].url"]),
    (recipe(list_pages__0__url="HTTPS://e.org:65535?a b"), ["invalid_url $.list_pages[0].url"]),
    (recipe(list_pages__0__item_selector="a:hover"), ["invalid_selector $.list_pages[0].item_selector"]),
    (recipe(list_pages__0__fields__url__attr=None), ["unsupported_value $.list_pages[0].fields.url.attr"]),
    (recipe(list_pages__0__fields__title__attr="href"), ["invalid_fields $.list_pages[0].fields.title"]),
    (recipe(list_pages__0__fields__title=None, list_pages__0__fields__body={"selector": "p", "read": "text"}), ["invalid_fields $.list_pages[0].fields"]),
    (recipe(list_pages__0__pagination__max_pages=11), ["invalid_integer $.list_pages[0].pagination.max_pages"]),
    (recipe(detail_templates__0__match__host="E.org", detail_templates__0__match__path_prefix="//x"), ["invalid_host $.detail_templates[0].match.host", "invalid_path $.detail_templates[0].match.path_prefix"]),
    (recipe(date_policy__source_timezone="Mars/Base"), ["invalid_timezone $.date_policy.source_timezone"]),
    (recipe(detail_templates__0__remove_selectors=["a"] * 17), ["invalid_array $.detail_templates[0].remove_selectors"]),
    (recipe(extractor="rss"), ["invalid_fields $"]),
    (recipe(extractor="rss", list_pages=None, feed={"url": "https://e.org/f", "fields": {"title": "title", "url": "link", "content": "body"}}), ["unsupported_value $.feed.fields.content"]),
    (recipe(list_pages=[recipe()["list_pages"][0]] * 4, detail_templates=[{"match": {"host": "e.org", "path_prefix": f"/{i}"}, "fields": {n: {"selector": "p", "read": "text"} for n in recipes.FIELDS}, "remove_selectors": ["a"] * 9} for i in range(8)]), ["limit_exceeded $"]),
    ([1], ["invalid_type $"]),
]


def test_recipes(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(RECIPES)] + [(100, "{"), (101, '{"a": 1, "a": 2}'), (102, None), (103, json.dumps(recipe(list_pages__0__url="https://e.org/" + "x" * 70_000)))]
    got = {}
    for r in recipes.recipe_check(spark.createDataFrame(rows, "recipe_id long, document string").repartition(3)).collect():
        got.setdefault(r.recipe_id, set()).add(f"{r.code} {r.path}")
    for i, (x, want) in enumerate(RECIPES):
        assert got.get(i, set()) == set(want), x
    assert got[100] == got[102] == {"invalid_json $"}
    assert {"duplicate_key $", "invalid_fields $"} == got[101]
    assert {"limit_exceeded $", "invalid_text $.list_pages[0].url"} == got[103]


def test_structured_data(spark):
    def page(*documents):
        return "".join(f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>' for d in documents)

    news = {"@type": "NewsArticle", "headline": " H ", "author": {"name": "A"}, "articleBody": 5}
    bodies = [
        page(news | {"url": "/0#x"}),
        page({"@graph": [{"@type": "Thing"}, {"@graph": [news | {"@id": "https://e.org/1"}]}]}),
        page([news | {"url": "https://e.org/other"}, news | {"url": "2"}]),
        page(news),
        page(news, news),
        page(news | {"url": "/5", "isAccessibleForFree": False}),
        page('{"@type": "Article", "url": "/6", "url": "/6"}'),
        page("{"),
        "<p>none</p>",
        page({"nested": news | {"url": "/9"}}),
        page(news | {"url": None}),
        page([{"a": i} for i in range(5000)]),
    ]
    pages = pages_of(spark, *bodies)
    clean = tree.clean_page(tree.page_trees(pages))
    got = {r.page_id: (r.error, r["values"]) for r in structured.jsonld_article(pages, clean, {"title": "headline", "author": "author.name", "content": "articleBody"}).collect()}
    fine, wrong = (None, {"title": "H", "author": "A"}), ("invalid_article", None)
    assert got == {0: fine, 1: fine, 2: fine, 3: fine, 4: wrong, 5: ("paywall", None), 6: wrong, 7: wrong, 8: wrong, 9: wrong, 10: wrong, 11: ("resource_limit", None)}


def card(title, href):
    return f"<article><h2><a href='{href}'>{title}</a></h2></article>"


def detail(title, text, at="2026-03-02 10:00"):
    return f"<h1>{title}</h1><time datetime='{at}'>x</time><main><p>{text} and enough other words to fill a paragraph of some length for certain.</p><aside><p>Buy now.</p></aside><p>The second paragraph about {title} is rather long as well, so that both of them make a full body of text in the end, with more than two hundred characters.</p></main>"


def test_recipe_extract(spark):
    captured = {
        "https://e.org/list": card("Alpha rises", "/n/alpha") + card("No link", "") + card("Beta falls", "https://e.org/n/beta") + "<a class=next href='/list?p=2'>more</a>",
        "https://e.org/list?p=2": card("Alpha again", "/n/alpha#top") + card("Gamma", "/other/gamma") + card("Evil", "https://x.org/a") + "<a class=next href='list?p=3'>more</a>",
        "https://e.org/list?p=3": card("Delta", "/n/delta") + card("Epsilon", "/n/wall") + "<a class=next href='/list'>more</a>",
        "https://e.org/n/alpha": detail("Alpha rises", "Alpha has risen"),
        "https://e.org/n/beta": detail("Something else", "Nothing alike"),
        "https://e.org/n/wall": "<div id=paywall></div>",
        "https://f.org/": "<p>no items</p>",
        "https://j.org/": card("Structured", "https://j.org/a/1"),
        "https://j.org/a/1": '<script type="application/ld+json">{"@type": "Article", "url": "https://j.org/a/1", "headline": "Structured", "author": {"name": "A"}, "datePublished": "2026-01-01T00:00:00Z"}</script>',
        "https://loop.org/": card("L", "/l") + "<a class=next href='/'>more</a>",
    }
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(captured.items())], "page_id long, url string, html string").repartition(3)
    typed = JSONLD | {"match": {"host": "j.org", "path_prefix": "/a/"}, "fields": JSONLD["fields"] | {"published_at": {"read": "jsonld", "path": ["datePublished"]}}}
    made = {1: recipe(), 2: recipe(list_pages__0__url="https://f.org"), 3: recipe(list_pages__0__url="https://j.org/", detail_templates=[typed]), 4: recipe(list_pages__0__url="https://gone.org/"), 5: recipe(list_pages__0__url="https://loop.org/", detail_templates=[])}
    table = spark.createDataFrame([(k, json.dumps(v)) for k, v in made.items()], "recipe_id long, document string")
    items, errors = extraction.recipe_extract(table, pages)
    got = {(r.recipe_id, r.page, r.item): r for r in items.collect()}
    brief = {k: (r.outcome, r.content_level, r.errors) for k, r in got.items()}
    assert brief == {
        (1, 0, 0): ("article", "full", []),
        (1, 0, 1): ("rejected", None, ["missing_fields"]),
        (1, 0, 2): ("article", "metadata_only", ["low_quality"]),
        (1, 1, 0): ("duplicate", None, []),
        (1, 1, 1): ("article", "metadata_only", []),
        (1, 1, 2): ("rejected", None, ["unsafe_url"]),
        (1, 2, 0): ("article", "metadata_only", ["no_evidence"]),
        (1, 2, 1): ("article", "metadata_only", ["paywall"]),
        (3, 0, 0): ("article", "metadata_only", []),
        (5, 0, 0): ("article", "metadata_only", []),
    }
    first = got[1, 0, 0]
    assert first.content.startswith("Alpha has risen") and "Buy" not in first.content and first.content.count("\n\n") == 1
    assert (first.published_at, first.published_at_source, first.language) == (datetime.datetime(2026, 3, 2, 9), "detail", "fr")
    assert first.external_id == hashlib.sha256(b"https://e.org/n/alpha").hexdigest()[:32]
    page, own = (hashlib.sha256(u).hexdigest() for u in (b"https://e.org/list", b"https://e.org/n/alpha"))
    assert [tuple(p) for p in first.provenance] == [("content", "css", f"doc:{own}:detail:0:content"), ("published_at", "css", f"doc:{own}:detail:0:published_at"), ("title", "css", f"doc:{own}:detail:0:title"), ("url", "css", f"doc:{page}:list:0:page:0:item:0:url")]
    assert (got[3, 0, 0].author, got[3, 0, 0].published_at_source, {p.method for p in got[3, 0, 0].provenance}) == ("A", "detail", {"css", "jsonld"})
    assert sorted((r.recipe_id, r.page, r.code) for r in errors.collect()) == [(2, 0, "no_evidence"), (4, 0, "no_evidence"), (5, 1, "redirect_limit")]
    report = {r.recipe_id: (r.status, r.discovered, r.extracted, r.valid, r.rejected, r.duplicate, [tuple(e) for e in r.errors]) for r in extraction.run_report(items, errors).collect()}
    assert report[1] == ("partial", 8, 8, 6, 2, 1, [("quality", "low_quality"), ("extraction", "missing_fields"), ("quality", "no_evidence"), ("transport", "paywall"), ("transport", "unsafe_url")])
    assert report[2][0] == report[4][0] == "inconclusive" and report[3][0] == "ready" and report[5] == ("partial", 1, 1, 1, 0, 0, [("transport", "redirect_limit")])


def test_recipe_item_limit(spark):
    cards = [card(f"Item {i}", f"/i/{i}") for i in range(150)]
    pages = spark.createDataFrame([(1, "https://e.org/list", "".join(cards[:150]) + "<a class=next href='/two'>x</a>"), (2, "https://e.org/two", "".join(card(f"Late {i}", f"/l/{i}") for i in range(60)))], "page_id long, url string, html string")
    items, _ = extraction.recipe_extract(spark.createDataFrame([(1, json.dumps(recipe(detail_templates=[])))], "recipe_id long, document string"), pages)
    counts = {r.outcome: r["count"] for r in items.groupBy("outcome").count().collect()}
    assert counts == {"article": 200, "dropped": 10}


def test_holdout_and_report(spark):
    names = ("alpha", "beta", "gamma")
    captured = {"https://e.org/list": "".join(card(f"{n.title()} rises", f"/n/{n}") for n in names) + "<a class=next href='/list2'>x</a>", "https://e.org/list2": card("Delta rises", "/m/delta")}
    captured |= {f"https://e.org/{'m' if n == 'delta' else 'n'}/{n}": detail(f"{n.title()} rises", f"{n.title()} has risen") for n in (*names, "delta")}
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(captured.items())], "page_id long, url string, html string").repartition(3)
    template = recipe()["detail_templates"][0]
    both = [template, template | {"match": {"host": "e.org", "path_prefix": "/m/"}}]
    plain = recipe(detail_templates=[])
    one_page = recipe(detail_templates=both, list_pages__0__pagination__max_pages=1)
    made = {
        1: (plain, recipe(detail_templates=both), ("passed", "controlled_holdout_checks_passed")),
        2: (plain, recipe(), ("failed", "detail_quality_failed")),
        3: (plain, one_page, ("failed", "inventory_or_template_coverage_failed")),
        4: (plain, recipe(detail_templates=[*both, template | {"match": {"host": "e.org", "path_prefix": "/z/"}}]), ("inconclusive", "insufficient_template_coverage")),
        5: (recipe(list_pages__0__url="https://gone.org/"), recipe(detail_templates=both), ("inconclusive", "insufficient_independent_details")),
    }
    base, candidate = (spark.createDataFrame([(k, json.dumps(v[i])) for k, v in made.items()], "recipe_id long, document string") for i in (0, 1))
    got = {r.recipe_id: (r.status, r.reason) for r in extraction.holdout_check(base, candidate, pages).collect()}
    assert got == {k: v[2] for k, v in made.items()}

    items, errors = extraction.recipe_extract(candidate.where("recipe_id = 1"), pages)
    [told] = extraction.extraction_report(items, errors, samples=3, most=20).collect()
    assert (told.status, told.levels, told.samples_truncated) == ("ready", {"full": 4}, True)
    assert [(s.title, s.excerpt, s.truncated) for s in told.samples] == [(f"{n.title()} rises", f"{n.title()} has risen and enough"[:20], True) for n in names]
