"""Directory, portfolio and list pages, snapshots, seeds and delivery logs on made cases."""

import datetime
import json

import pytest
from newsloom.sources import captures, directories, tree
from pyspark.errors import AnalysisException

AT = datetime.datetime(2026, 1, 5, 12)


def trees(spark, *rows):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, source_id long, page int, url string, html string")
    return tree.page_trees(table)


def test_directory_entries(spark):
    one = "<div data-name=' Alpha ' data-description='Makes chips' data-link='alpha.example' data-year=2020></div><div data-name=A data-description=x></div><div data-name='Calque 1' data-description=x></div><a href='/startup/beta'>Beta</a><a href='/startup/alpha'>ALPHA</a>"
    two = "<a href='https://e.org/annuaire/gamma/'>Gam<b>ma</b></a><a href='/annuaire/'>Index</a><a href='/annuaire/page/2'>Two</a><a href='/annuaire/x'>next</a><a href='/other'>Other</a><p>Delta, a long description of it.</p>"
    three = "<p>Delta: a long description of it, really.</p><nav>Contact us, please write to somebody now</nav><p>Eps, short</p><script>Zeta, a long description of it.</script><p>Delta, again some long words</p>"
    got = {}
    for r in directories.directory_entries(trees(spark, (1, 0, "u", one), (1, 1, "u", two), (2, 0, "u", three), (3, 0, "u", None))).collect():
        got.setdefault(r.source_id, set()).add(tuple(r)[1:])
    assert got == {
        1: {("Alpha", "Makes chips", "https://alpha.example", "2020"), ("Beta", None, None, None), ("Gamma", None, "https://e.org/annuaire/gamma/", None)},
        2: {("Delta", "a long description of it, really.", None, None)},
    }


def test_directory_facts(spark):
    page = lambda kind, address: f"<nav>x</nav><h2>Type of Organization</h2><p>{kind}</p><p>Year founded 2001</p><h3>Contact details</h3><p>Adress {address}</p><script>var a</script><p>Website e.org</p>"
    rows = [(1, 0, "u", page("SME / other", "1 rue X 38400 SAINT-MARTIN-D'HÈRES CEDEX 9")), (1, 1, "u", page("Cluster", "69001  LYON")), (1, 2, "u", page("Unknown", "Paris")), (1, 3, "u", None)]
    got = [tuple(r)[1:] for r in directories.directory_facts(trees(spark, *rows)).orderBy("page_id").collect()]
    assert got == [("38400", "Saint-Martin-D'Hères", "company", True), ("69001", "Lyon", "ecosystem_support", False), (None, None, None, True), (None, None, None, True)]


def test_portfolio_and_cards(spark):
    items = "<i data-name=Alpha data-description=Chips data-year=2020 data-link=a.example></i><i data-name=Alpha data-description=More></i><i data-name=Beta data-description='' ></i><i data-name='Santé' data-description=x></i><i data-name=Gamma data-description=G></i>"
    got = {(r.title, r.url, r.content) for r in directories.portfolio_items(trees(spark, (1, 0, "https://e.org/p", items))).collect()}
    assert got == {("Alpha (2020)", "https://a.example", "Chips"), ("Gamma", "https://e.org/p#Gamma", "G")}
    cards = "<article><a href='/article/1'><h2>A title long enough</h2></a><p>First.</p><p>Second.</p><img data-src=/i.png></article><article><a href='/article/1'>x</a><h3>Another long title</h3></article><article><a href='/other/2'></a><h2>A title long enough</h2></article><article><h2>No link in this one</h2></article><article><a href='/article/3'></a><h2>Short</h2></article>"
    got = [(r.title, r.url, r.content, r.image_url) for r in directories.article_cards(trees(spark, (1, 0, "u", cards))).collect()]
    assert got == [("A title long enough", "/article/1", "First.", "/i.png")]


def test_html_items(spark):
    page = "<ul><li class=n><a href='/1'>One</a><span class=d>2026-01-02T03:04:05Z</span><img src=/i.png></li><li class=n><a href='mailto:x'>Two</a></li><li class=n><a href='//f.org/3'>Three</a><time datetime='2026-02-03 04:05'>yesterday</time><em>Me</em></li></ul>"
    selectors = spark.createDataFrame([("s", "li.n", "a", "a", None, "em", "img", "time"), ("t", "li.n", "a", "a", "span", None, None, "span.d")], "scope string, item string, link string, title string, content string, author string, image string, date string")
    held = trees(spark, (1, 0, "https://e.org/list", page)).crossJoin(spark.createDataFrame([("s",), ("t",)], "scope string"))
    got = {(r.scope, r.item): (r.title, r.url, r.author, r.image_url, r.published_at) for r in directories.scan_html_items(held, selectors).collect()}
    assert got == {
        ("s", 0): ("One", "https://e.org/1", None, "/i.png", None),
        ("s", 2): ("Three", "https://f.org/3", "Me", None, datetime.datetime(2026, 2, 3, 4, 5)),
        ("t", 0): ("One", "https://e.org/1", None, None, datetime.datetime(2026, 1, 2, 3, 4, 5)),
        ("t", 2): ("Three", "https://f.org/3", None, None, None),
    }


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([("u/1", "u/1", AT, "body é"), ("u/2", "u/2", AT + datetime.timedelta(days=1), "")], "url string, document_url string, fetched_at timestamp, body string")
    path = str(tmp_path / "pages")
    captures.write_snapshots(pages, path)
    with pytest.raises(AnalysisException):
        captures.write_snapshots(pages, path)
    assert sorted(r.url for r in captures.scan_pages(spark, path).collect()) == ["u/1", "u/2"]
    assert [r.url for r in captures.scan_pages(spark, path, "2026-01-05").collect()] == ["u/1"]
    stored = spark.read.parquet(path)
    assert captures.sound_pages(stored.selectExpr("concat(body, 'x') as body", "snapshot_id", "response_bytes")).count() == 0

    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps([{"slug": "a", "name": "A", "ai_analysis": {"x": 1}, "more": 2}, {"slug": "b"}]))
    assert [(r.slug, r.name, r.ai_analysis) for r in captures.scan_seed(spark, str(seed)).collect()] == [("a", "A", '{"x": 1}'), ("b", None, None)]

    told = spark.createDataFrame([(1, 3, None), (2, 5, "refused")], "user_id long, n_articles long, error string")
    log = captures.delivery_log(told, "daily_digest", AT)
    for _ in range(2):
        captures.append_deliveries(log, str(tmp_path / "log"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect()), key=repr) == sorted([(1, "daily_digest", 3, "sent", None, AT), (2, "daily_digest", None, "failed", "refused", AT)] * 2, key=repr)
