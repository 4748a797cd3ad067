"""Rules of lists, contracts, links and histories on made cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.times import parse_date
from newsloom.operators import audits, contracts, linking, reader

D = datetime.datetime


def test_dates_with_and_without_offsets(spark):
    cases = [
        ("2026-01-10T12:00:00+02:00", D(2026, 1, 10, 10)),
        ("2026-01-10T12:00:00Z", D(2026, 1, 10, 12)),
        ("Sat, 10 Jan 2026 12:00:00 +0100", D(2026, 1, 10, 11)),
        ("10 Jan 2026 12:00:00 GMT", D(2026, 1, 10, 12)),
        ("2026-01-10 12:00", D(2026, 1, 10, 11)),
        ("2026-07-10T12:00:00", D(2026, 7, 10, 10)),
        ("2026-03-29 02:30", None),  # the clock skips it
        ("2026-10-25 02:30", None),  # the clock shows it twice
        ("2026-10-25 03:30", D(2026, 10, 25, 2, 30)),
        ("2026-01-10", None),
        ("soon", None),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame(cases, "t string, want timestamp")
    assert all(r.want == r.got for r in rows.select("want", parse_date(F.col("t"), "Europe/Paris").alias("got")).collect())
    bare = spark.createDataFrame([("2026-01-10 12:00",)], "t string")
    assert bare.select(parse_date(F.col("t")).alias("d")).first().d is None


def test_article_contract(spark):
    fine = ("e1", "Title", "https://a.example/x", "fr", "body", "full", D(2026, 1, 1), "feed", None, ["title", "url", "content", "published_at"])
    change = lambda **new: tuple(new.get(n, v) for n, v in zip(("external_id", "title", "url", "source_language", "content", "content_level", "published_at", "published_at_source", "author", "provenance"), fine))
    cases = [
        (fine, []),
        (change(external_id=""), ["external_id"]),
        (change(title="  "), ["title"]),
        (change(url="https://u@a.example/"), ["url"]),
        (change(url=None), ["url"]),
        (change(source_language="French"), ["source_language"]),
        (change(content="é" * 40_000), ["content"]),
        (change(content=None), ["content_level"]),
        (change(published_at=None), ["published_at_source"]),
        (change(author="A"), ["provenance"]),
        (change(provenance=["title", "url", "url", "content", "published_at"]), ["provenance"]),
    ]
    shape = "n int, external_id string, title string, url string, source_language string, content string, content_level string, published_at timestamp, published_at_source string, author string, provenance array<string>"
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], shape)
    got = {r.n: r.failed for r in rows.select("n", contracts.broken(contracts.article_rules()).alias("failed")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_decisions_fold_in_order(spark):
    rows = [(1, 7, "approve", 10), (2, 7, "approve", 11), (3, 7, "reject", 12), (4, 7, "rollback", None), (5, 8, "rollback", None), (6, 8, "approve", 3), (7, 8, "retire", None)]
    got = audits.decision_history(spark.createDataFrame(rows, "id long, profile_id long, action string, version long").repartition(3))
    assert sorted(map(tuple, got.collect())) == [(7, 10, 11), (8, None, 3)]


def test_review_file_is_refused(spark):
    rows = spark.createDataFrame([("a", "A", "keep", "", "", "", ""), ("a", "A", "drop", "", "", "", "2"), ("", "B", "flag", "club", "", "", None)], "slug string, name string, action string, entity_type string, postcode string, city string, local_site string")
    assert linking.review_errors(rows).first().asDict() == {"action": 1, "entity_type": 1, "local_site": 2, "empty_slug": 1, "repeated_slug": 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_links_of_names(spark, parts):
    companies = spark.createDataFrame([(1, "soitec", ["SOI-TEC"]), (2, "cea-leti", None), (3, "x", ["leti"])], "id long, slug string, aliases array<string>")
    names = [(5, 1, " Soitec ", False), (5, 2, "soi-tec", False), (5, 3, "Leti", True), (5, 4, "New Co", True), (5, 5, "new-co", False), (5, 6, "!!", True), (6, 1, "CEA Leti", False), (6, 2, "Other", False)]
    got = linking.link_mentions(spark.createDataFrame(names, "article_id long, position int, name string, is_local boolean").repartition(parts), companies)
    assert sorted((r.article_id, r.company_id or 0, r.name, r.status) for r in got.collect()) == [(5, 0, "New Co", "pending"), (5, 1, "Soitec", "known"), (5, 3, "Leti", "known"), (6, 0, "Other", "approved"), (6, 2, "CEA Leti", "known")]


def test_seeds_merge_twice_as_once(spark):
    companies = spark.createDataFrame([("a", "A", "", "w"), ("b", "B", "old", None)], "slug string, name string, sector string, website string")
    seeds = spark.createDataFrame([("a", "A2", "s", "v"), ("c", "C", None, None)], "slug string, name string, sector string, website string")
    once = linking.seed_merge(companies, seeds, ("sector", "website"))
    assert sorted(map(tuple, once.collect())) == [("a", "A", "s", "w", "updated"), ("b", "B", "old", None, "kept"), ("c", "C", None, None, "added")]
    twice = linking.seed_merge(once.drop("outcome"), seeds, ("sector", "website"))
    assert sorted(r.outcome for r in twice.collect()) == ["kept", "skipped", "skipped"]


def test_visible_text(spark):
    texts = [("Ｅté\u00a0 x", "eté x"), ("ABC  d\n", "abc d"), ("Straße", "strasse"), ("", "")]
    import hashlib

    got = spark.createDataFrame(texts, "t string, want string").select("want", X.visible_text_hash(F.col("t")).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.want.encode()).hexdigest() for r in got)


def test_search_ignores_accents(spark):
    rows = spark.createDataFrame([(1, "Société"), (2, "SOCIETE 100%"), (3, None), (4, "x")], "id long, t string")
    assert [r.id for r in rows.where(reader.holds(F.col("t"), "socié")).collect()] == [1, 2]
    assert [r.id for r in rows.where(reader.holds(F.col("t"), "0%")).collect()] == [2]
