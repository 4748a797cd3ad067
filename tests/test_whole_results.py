"""What queries must give where tables hold odd names of characters, long lists and skewed keys."""

from pyspark.sql import functions as F

from newsloom.sources import directories, fields, tree

LIST = "".join(f"<article><a href='/i/{i}'>Item {i}</a></article>" for i in range(320))


def pages_of(spark, *bodies):
    return spark.createDataFrame([(i, f"https://e.org/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_a_name_counts_with_its_semicolon_only(spark):
    body = "<title>a &amp;&amp b</title><h1>c&amp</h1><p>&copy; &copy</p><script type='application/ld+json'>{\"x\": \"1 && 2 &amp; &lt\"}</script>"
    seen = tree.clean_page(tree.page_trees(pages_of(spark, body))).first()
    assert seen.title == "a &&amp b" and seen.text == "a &&amp b c&amp © &copy" and list(seen.paragraphs) == ["© &copy"]
    assert list(seen.structured) == ['{"x": "1 && 2 &amp; &lt"}']
    # the mark that stands for a loose ampersand is none that the page holds
    assert tree.clean_page(tree.page_trees(pages_of(spark, "<title>&#38; &#038; & &#38</title>"))).first().title == "& & & &#38"


def test_read_fields_and_cards_keep_loose_names(spark):
    trees = tree.page_trees(pages_of(spark, "<article><a href='/x'><h2>Title of it&amp</h2></a></article>")).withColumn("scope", F.lit("page"))
    rules = spark.createDataFrame([("page", "title", "article > a", "text", None)], "scope string, field string, selector string, read string, attr string")
    assert fields.read_fields(trees, rules).first()["values"]["title"] == "Title of it&amp"
    assert directories.article_cards(trees, part="/").first().title == "Title of it&amp"


def test_list_pages_give_all_their_items(spark):
    trees = tree.page_trees(pages_of(spark, LIST)).withColumn("scope", F.lit("list"))
    selectors = spark.createDataFrame([("list", "article", "a[href]", "a", None, None, None, None)], "scope string, item string, link string, title string, content string, author string, image string, date string")
    found = sorted((r["item"], r.title, r.url) for r in directories.scan_html_items(trees, selectors).collect())
    assert found == [(i, f"Item {i}", f"https://e.org/i/{i}") for i in range(320)]


def test_items_beyond_the_most_of_a_run_are_dropped_one_by_one(spark):
    import json

    from newsloom.sources.extraction import recipe_extract, run_report

    rule = {"title": {"selector": "a", "read": "text"}, "url": {"selector": "a", "read": "attr", "attr": "href"}}
    form = {"source_id": 1, "locale": "fr", "list_pages": [{"url": "https://e.org/0", "item_selector": "article", "fields": rule}], "detail_templates": []}
    items, errors = recipe_extract(spark.createDataFrame([("r", json.dumps(form))], "recipe_id string, document string"), pages_of(spark, LIST))
    assert sorted((r["item"], r.outcome) for r in items.collect()) == [(i, "article" if i < 200 else "dropped") for i in range(320)]
    told = run_report(items, errors).first()
    assert (told.status, told.discovered, told.extracted, told.valid) == ("partial", 320, 200, 200) and [e.code for e in told.errors] == ["resource_limit"]


def test_sources_without_state_at_any_zone(spark, tmp_path):
    import duckdb

    from newsloom.plans.queries import QUERIES, SQL

    # keys of a larger table: runs after the last Sunday of March, when the clock of Paris goes on by an hour
    spark.range(9_000, 9_200).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted((r.source_id, r.next_due_at) for r in QUERIES["sources_without_state"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(SQL["sources_without_state"]).fetchall())


def test_directories_over_several_pages(spark, tmp_path):
    import duckdb

    from newsloom.plans import audit_queries
    from newsloom.plans.queries import QUERIES, SQL

    # more than one page of 512 KB can hold of a nation's suppliers
    rows = spark.range(24_000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey"), F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("s_name"))
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    for name in ("directory_entries", "portfolio_items"):
        df = QUERIES[name](spark, str(tmp_path))
        found = con.execute(SQL[name])
        order = [d[0] for d in found.description]
        assert sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(repr, found.fetchall()))
    sizes = audit_queries._directories(spark, str(tmp_path)).select(F.size("nodes").alias("n")).collect()
    assert len(sizes) == 15 and max(r.n for r in sizes) <= 3 * audit_queries.LISTED_KEYS


def test_session_spend_of_rows_without_usage(spark):
    from newsloom.operators.spending import session_spend

    rows = spark.createDataFrame([(1, 1, "d", "settled", 10, 4, 5, 5, None), (1, 1, "d", "reserved", 10, 4, 5, 5, 7), (2, 1, "d", "reserved", 3, 1, 2, 2, 8), (2, 2, "e", "reserved", 1, 1, 1, 1, None)], "session_id int, source_id int, day string, state string, reserved long, actual long, input_limit long, output_limit long, usage_id long")
    usage = spark.createDataFrame([(7, 20, 30)], "id long, input_tokens long, output_tokens long")
    found = session_spend(rows, usage)
    assert {(r.session_id, r.calls, r.spent, r.tokens) for r in found.where("session_id is not null").collect()} == {(1, 2, 14, 60), (2, 2, 4, 6)}
    # nulls are no key of the join
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(usage_id" in plan and "Union" in plan


def test_left_join_spreads_heavy_keys(spark, monkeypatch):
    from newsloom.operators import audits

    monkeypatch.setattr(audits, "KEY_BUCKETS", 256)
    rows = spark.range(4_000).select("id", F.when(F.col("id") % 4 == 0, F.lit(-1)).when(F.col("id") % 4 == 1, F.lit(None)).when(F.col("id") % 4 == 2, F.lit(5)).otherwise(F.col("id")).cast("long").alias("k"))
    other = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    monkeypatch.setattr(audits, "HEAVY", 50)
    plan = audits.left_join_spread(rows, other, "k")
    assert "Union" in plan._jdf.queryExecution().analyzed().toString()
    assert sorted(((r.id, r.k, r.v) for r in plan.collect()), key=repr) == sorted(((r.id, r.k, r.v) for r in rows.join(other, "k", "left").collect()), key=repr)
    assert rows.join(other, "k", "left").count() == 4_000


def test_json_is_read_in_bounded_parts(spark):
    from newsloom.sources import documents

    assert list(documents._cut([1] * 130)) == [(0, 64), (64, 128), (128, 130)]
    assert list(documents._cut([10, documents.READ_CHARS + 1, 10, 10])) == [(0, 1), (1, 2), (2, 4)] and list(documents._cut([])) == []
    texts = [(i, None if i % 7 == 0 else "{" if i % 7 == 1 else f'{{"a": [{i}, "x"]}}') for i in range(1_000)]
    rows = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    found = {r.id: r.n for r in rows.select("id", documents.json_nodes("t").alias("n")).collect()}
    assert len(found) == 1_000 and all((found[i] is None) == (i % 7 < 2) for i in found)
    assert [n.text for n in found[999]] == [None, None, "999", "x"]


def test_outputs_are_read_once(spark):
    from newsloom.operators.outputs import validate_model_output

    rows = spark.createDataFrame([(1, "sentiment", '{"sentiment": "x", "score": 0, "reason": "", "score": 2}'), (2, "sentiment", "["), (3, "other", "free")], "output_id int, task string, text string")
    got = {r.output_id: (r.valid, [tuple(f) for f in r.failures]) for r in validate_model_output(rows).collect()}
    assert got[1][0] is False and sorted(got[1][1]) == [("choice", "$.sentiment"), ("duplicate_key", "$"), ("range", "$.score")]
    assert got[2] == (False, [("json", "$")]) and got[3] == (True, [])
    plan = validate_model_output(rows.withColumn("task", F.lit("sentiment")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_nodes(") == 1 and "_is_selector" not in plan


def test_blocks_of_matches(spark):
    from newsloom.operators.alerts import keyword_matches

    subs = spark.createDataFrame([(1, 9, "beta"), (1, 4, "alpha"), (2, 1, "BETA"), (3, 2, "none")], "user_id int, subscription_id int, keyword string")
    ids = [-5_000, -1, 0, 4_095, 4_096, 10**12]
    want = [(1, "alpha" if i % 2 == 0 else "beta") for i in range(6)]
    for kind, key in (("long", lambda i: ids[i]), ("string", lambda i: f"a{ids[i]}")):
        texts = spark.createDataFrame([(key(i), "beta and alpha" if i % 2 == 0 else "Beta") for i in range(6)], f"article_id {kind}, text string")
        found = keyword_matches(subs, texts)
        assert found.schema["article_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
        got = sorted(map(tuple, found.collect()))
        assert got == sorted([(u, key(i), w) for i, (u, w) in enumerate(want)] + [(2, key(i), "BETA") for i in range(6)])
        assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_digest_names_every_reader(spark):
    from newsloom.operators.reader import digest_with_readers

    digest = spark.createDataFrame([("fr", "top", 1, 7, "t"), ("fr", "rest", 1, 8, "u"), ("en", "top", 1, 7, "v")], "language string, section string, rank int, id long, title string")
    users = spark.createDataFrame([(1, True, True, "fr"), (2, True, True, None), (3, True, False, "fr"), (4, True, True, "en")], "user_id long, is_active boolean, wants_digest boolean, language string")
    rows = digest_with_readers(digest, users)
    assert rows.where("section <> 'reader'").count() == 3
    assert sorted((r.user_id, r.language, r.n_articles) for r in rows.where("section = 'reader'").collect()) == [(1, "fr", 2), (4, "en", 1)]


def test_pages_of_any_size_are_read_whole(spark):
    bodies = ("<p>a</p>" * 11_000, "<div>" * 70 + "x", "<p>" + "word " * 120_000 + "</p>")
    shown = lambda trees: [(r.error, r.n) for r in trees.selectExpr("page_id", "error", "size(nodes) AS n").orderBy("page_id").collect()]
    assert shown(tree.page_trees(pages_of(spark, *bodies), limited=False)) == [(None, 22_001), (None, 72), (None, 3)]
    assert {error for error, _ in shown(tree.page_trees(pages_of(spark, *bodies)))} == {"resource_limit"}
    # pages of a batch keep their own nodes, wherever it is cut
    several = tree.page_trees(pages_of(spark, *[f"<i>{i}</i>" * (12_000 if i % 7 == 0 else 1) for i in range(150)]).coalesce(1), limited=False)
    assert [r.t for r in several.selectExpr("page_id", "nodes[2].text AS t").orderBy("page_id").collect()] == [str(i) for i in range(150)]


def test_long_values_are_read_whole(spark):
    text = "word " * 20_000
    rules = spark.createDataFrame([("page", "title", "p", "text", None)], "scope string, field string, selector string, read string, attr string")
    trees = tree.page_trees(pages_of(spark, f"<p>{text}</p>")).withColumn("scope", F.lit("page"))
    assert fields.read_fields(trees, rules, limited=False).first()["values"] == {"title": text.strip()}
    assert fields.read_fields(trees, rules).first().error == "resource_limit"


def test_every_card_of_a_repeated_link(spark):
    trees = tree.page_trees(pages_of(spark, "<article><a href='/x'><h2>The first title</h2></a></article><article><a href='/x'><h2>The second title</h2></a></article>"))
    assert sorted(r.title for r in directories.article_cards(trees, part="/", repeats=True).collect()) == ["The first title", "The second title"]
    assert directories.article_cards(trees, part="/").first().title == "The first title"


def test_large_hosts_and_texts_as_in_sql(spark, tmp_path):
    import duckdb

    from newsloom.plans.queries import QUERIES, SQL

    def page(i):
        text = "word and more " * 6_000 if i == 7 else f"The text of number {i}."
        url = f"https://e.org/{'x' * 400}/{i - i % 1000 % 2 if i > 2_000 else i}"  # some links twice
        return 3 * i, url, f'<html lang="fr"><head><title>t</title></head><body><article><h1>Title number {i}</h1><p>{text}</p><p>Number {i}.</p></article></body></html>'

    rows = [page(i) for i in range(2_600)] + [(20_000, "https://f.org/1", page(1)[2])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("article_cards", "read_fields", "recipe_extract", "run_report", "scan_html_items"):
        df = QUERIES[name](spark, str(tmp_path))
        wanted = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(wanted, key=repr), name
