"""Rules that SQL cannot express, against plain Python, and corner cases."""

import datetime
from collections import defaultdict

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import alerts, ledgers, merges
from newsloom.plans import adapters
from newsloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_admission_is_greedy_in_order(spark):
    rows = [(r.id, r.config_id, r.created_at, r.cost_cents) for r in adapters.usage(spark, SF).collect()]
    held, expected = defaultdict(int), {}
    for i, ledger, at, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (ledger, at.date())
        fits = held[key] + cost <= 50_000
        held[key] += cost * fits
        expected[i] = (fits, held[key])
    got = {r.id: (r.admitted, r.held) for r in QUERIES["admission_replay"](spark, SF).collect()}
    assert got == expected and len({fits for fits, _ in got.values()}) == 2


def _calls(spark, outcomes):
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, 7, start + datetime.timedelta(seconds=s), ok) for i, (s, ok) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "id long, provider long, created_at timestamp, success boolean")


OUTCOMES = [(i, False) for i in range(5)] + [(10, False), (311, True), (312, True), (313, False), (314, True), (315, False), (5000, False)]


def test_breaker_opens_tries_and_closes(spark):
    got = {r.id: (r.status, r.n_failures) for r in ledgers.failure_breaker(_calls(spark, OUTCOMES)).collect()}
    assert [got[i] for i in range(12)] == [
        *[("closed", n) for n in (1, 2, 3, 4, 5)],
        ("open", 6),
        ("half_open", 6),
        ("half_open", 0),
        ("closed", 1),
        ("closed", 0),
        ("closed", 1),
        ("closed", 1),
    ]


def test_breaker_stream_equals_batch(spark, tmp_path):
    from newsloom.streaming.breaker import failure_breaker_stream

    calls = _calls(spark, OUTCOMES)
    calls.where("id < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = failure_breaker_stream(source).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    query.processAllAvailable()
    calls.where("id >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    columns = ["id", "provider", "status", "n_failures"]
    assert sorted(map(tuple, spark.table("breaker").collect())) == sorted(map(tuple, ledgers.failure_breaker(calls).select(columns).collect()))


def test_quote_rounds_up(spark):
    from decimal import Decimal

    d = lambda x: F.lit(Decimal(x))
    row = spark.range(1).select(ledgers.quote_usd(d("0.0001"), F.lit(1), d("0.0002"), F.lit(3)).alias("q"), ledgers.quote_usd(d("-1"), F.lit(1), d("1"), F.lit(1)).alias("bad")).first()
    assert row.q == Decimal("0.000001") and row.bad is None


def test_next_due(spark):
    d = datetime.datetime
    cases = [
        # started, finished, kind, streak, period, asked -> due; one o'clock in Paris is midnight UTC in winter, eleven in the evening in summer
        (d(2026, 1, 10, 12), d(2026, 1, 10, 13), "ok", 0, 1440, None, d(2026, 1, 11, 0)),
        (d(2026, 7, 10, 22, 0), d(2026, 7, 10, 22, 1), "ok", 0, 1440, None, d(2026, 7, 10, 23)),
        (d(2026, 7, 10, 22, 45), d(2026, 7, 10, 22, 50), "extraction", 2, 1440, None, d(2026, 7, 11, 22, 45)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "ok", 0, 60, None, d(2026, 1, 10, 13)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "ok", 0, None, None, d(2026, 1, 10, 12, 15)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "retry", 0, 60, None, d(2026, 1, 10, 12, 25)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "retry", 3, 360, None, d(2026, 1, 10, 13, 10)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "retry", 30, 360, None, d(2026, 1, 10, 18, 10)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "retry", 1, 60, 200_000, d(2026, 1, 11, 12, 10)),
        (d(2026, 1, 10, 12), d(2026, 1, 10, 12, 10), "blocked", 1, 60, None, d(2026, 1, 11, 12, 10)),
    ]
    rows = spark.createDataFrame(cases, "started timestamp, finished timestamp, kind string, streak int, period int, asked int, due timestamp")
    got = rows.select("due", ledgers.next_due(*map(F.col, ("started", "finished", "kind", "streak", "period", "asked"))).alias("d")).collect()
    assert [r.d for r in got] == [r.due for r in got]
    turned = spark.createDataFrame([(d(2026, 3, 28, 12),), (d(2026, 10, 24, 12),)], "t timestamp")
    two = [r.d for r in turned.select(ledgers.next_due(F.col("t"), F.col("t"), F.lit("ok"), F.lit(0), F.lit(1440), hour=2).alias("d")).collect()]
    assert two == [d(2026, 3, 29, 1), d(2026, 10, 25, 0)]


def test_as_of_does_not_depend_on_the_zone_of_the_driver(spark, monkeypatch):
    import time

    from newsloom.functions.times import moment

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        got = spark.range(1).select(moment(datetime.datetime(2001, 8, 1)).cast("string").alias("a"), moment(datetime.datetime(2001, 8, 1, tzinfo=datetime.timezone.utc)).cast("string").alias("b")).first()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert tuple(got) == ("2001-08-01 00:00:00", "2001-08-01 00:00:00")


def test_null_keys_are_one_key_and_null_outcomes_change_nothing(spark):
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, None, start + datetime.timedelta(seconds=i), None if i == 3 else False) for i in range(7)]
    got = ledgers.failure_breaker(spark.createDataFrame(rows, "id long, provider long, created_at timestamp, success boolean")).collect()
    assert sorted((r.id, r.status, r.n_failures) for r in got) == [(0, "closed", 1), (1, "closed", 2), (2, "closed", 3), (3, "closed", 3), (4, "closed", 4), (5, "closed", 5), (6, "open", 6)]


def test_chained_merges_end_at_the_last_target(spark):
    links = spark.createDataFrame([(1, 12, "positive", 1, True, 0.5)], "article_id long, company_id long, sentiment string, mention_count long, is_primary boolean, score double")
    got = merges.merge_links(links, spark.createDataFrame([(11, 12), (10, 11)], "target_id long, duplicate_id long")).collect()
    assert [r.company_id for r in got] == [10]


def test_slug_and_name_keys_fold_as_decomposition_does(spark):
    names = [("\ufb01nance \u00bd", "finance-12"), ("Été à Grenoble!", "ete-a-grenoble"), ("œuf", "uf"), ("", ""), (None, None), ("日本", "")]
    assert all(r.s == r.slug for r in spark.createDataFrame(names, "n string, slug string").select("slug", X.slug(F.col("n")).alias("s")).collect())


def test_merge_folds_several_duplicates(spark):
    links = [(1, 10, None, 1, False, None), (1, 11, "neutral", 5, False, 0.1), (1, 12, "positive", 2, True, 0.9), (2, 11, "negative", 1, False, 0.4), (3, 20, "neutral", 1, False, None)]
    df = spark.createDataFrame(links, "article_id long, company_id long, sentiment string, mention_count long, is_primary boolean, score double")
    got = merges.merge_links(df, spark.createDataFrame([(10, 11), (10, 12)], "target_id long, duplicate_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 5, True, "positive", 0.9), (2, 10, 1, False, "negative", 0.4), (3, 20, 1, False, "neutral", None)]


def test_duplicate_companies_chain(spark):
    names = ["Soitec SA", "SOITEC", "Grenoble Labo", "labo grenoble", "Labogrenoble", "Été Robotics", "ete-robotics France", "abc", "ABC", None, ""]
    names += ["Soitec"]
    rows = spark.createDataFrame([(i, i in (0, 2), n, "rejected" if i == 11 else None) for i, n in enumerate(names)], "id long, is_auto_created boolean, name string, review_status string")
    got = {r.id: (r.keeper_id, r.group_size) for r in merges.duplicate_companies(rows).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (3, 3), 3: (3, 3), 4: (3, 3), 5: (5, 2), 6: (5, 2)}


def test_strip_html(spark):
    cases = [
        (None, None),
        ("", ""),
        ("<p>a &amp; b<br/>c</p>\n\n\n<div> d&nbsp; </div>", "a & b\nc\n\nd"),
        ("no tags", "no tags"),
        ("<b>", ""),
        ("a\n \n\n b", "a\n\nb"),
        (" &lt;p&gt; ", "<p>"),
        ("<ul><li>one</li><li>two  three</li></ul>", "one\ntwo three"),
    ]
    for row in spark.createDataFrame(cases, "html string, want string").select("want", X.strip_html(F.col("html")).alias("text")).collect():
        assert row.text == row.want


def test_titles_and_bodies(spark):
    rows = spark.createDataFrame(
        [("The new chip", "A chip\n\nother", True), ("New chip", "none\n\nhere", False), ("of a", "anything", True), ("chip", "chip\n\nchip\n\nchip", False), ("芯片新闻", "关于芯片的", True), ("chip", None, False), (None, "x", False)],
        "title string, body string, expected boolean",
    )
    assert all(r.m == r.expected for r in rows.select("expected", X.body_matches_title(F.col("title"), F.col("body")).alias("m")).collect())
    pair = lambda a, b: spark.range(1).select(X.titles_match(F.lit(a), F.lit(b)).alias("m")).first().m
    assert pair("Chip plant opens", "the plant opens Friday") and not pair("a b c d", "x y z a") and not pair("", "x")


def test_sector_group_earliest_then_first(spark):
    groups = {"Energy": ["solar", "power"], "Health": ["medical"], "Food": ["solar"]}
    got = [r.g for r in spark.createDataFrame([("Medical solar",), ("solar",), ("Health",), ("biomedical",), ("",), (None,)], "s string").select(X.sector_group(F.col("s"), groups).alias("g")).collect()]
    assert got == ["Health", "Energy", "Health", "Other", "Other", "Other"]


def test_keywords(spark):
    lists = spark.createDataFrame([(1, " chip, chip ,, ai"), (2, None)], "user_id long, keywords string")
    assert sorted(map(tuple, alerts.unique_keywords(lists).collect())) == [(1, "ai"), (1, "chip")]
    subs = spark.createDataFrame([(1, 5, "AI"), (1, 4, "chips"), (2, 6, "x"), (3, 7, ""), (3, 8, None)], "user_id long, subscription_id long, keyword string")
    texts = spark.createDataFrame([(10, "Main CHIPS"), (11, None), (12, ""), (13, "x")], "article_id long, text string")
    assert sorted(map(tuple, alerts.keyword_matches(subs, texts).collect())) == [(1, 10, "chips"), (2, 13, "x")]


def test_upsert_prefers_external_id_and_refuses_moved_ones(spark):
    stored = spark.createDataFrame([(1, 1, "a", "u1", "excerpt", "t"), (1, 2, "b", "u2", None, "t"), (1, 3, "c", "u3", None, None)], "source_id long, id long, external_id string, url string, content_level string, content string")
    incoming = spark.createDataFrame([(1, "a", "u9", "full", "t"), (1, "z", "u3", "excerpt", "t"), (1, "b", "u2", "full", "t"), (2, "a", "u1", "full", "t")], "source_id long, external_id string, url string, content_level string, content string")
    got = {(r.source_id, r.external_id): (r.stored_id, r.action, r.source_failed) for r in merges.upsert_articles(stored, incoming).collect()}
    assert got == {(1, "a"): (1, "conflict", True), (1, "z"): (3, "updated", True), (1, "b"): (2, "duplicate", True), (2, "a"): (None, "new", False)}
