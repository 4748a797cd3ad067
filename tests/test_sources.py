"""Feeds, crawling rules, links and streaks on made cases."""

import datetime

from newsloom.sources import content, feeds, robots
from newsloom.streaming.streak import failure_streak_stream, streak_step
from pyspark.sql import functions as F


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="/s"/><link href="https://e.org/a"/><summary>s</summary><updated>2026-01-02T03:04:05Z</updated></entry></feed>'
    rows = [(1, atom), (2, "<rss version='2.0'><channel><title>x</title></channel></rss>"), (3, "<rss><channel>"), (4, None), (5, "<html></html>"), (6, "")]
    table = spark.createDataFrame(rows, "feed_id long, body string")
    assert {r.feed_id: (r.status, r.n_items) for r in feeds.feed_status(table).collect()} == {1: ("items", 1), 2: ("empty", 0), 3: ("malformed", 0), 4: ("malformed", 0), 5: ("malformed", 0), 6: ("malformed", 0)}
    [item] = feeds.scan_feed(table).collect()
    assert (item.title, item.url, item.content, item.published_at, len(item.external_id)) == ("A", "https://e.org/a", "s", datetime.datetime(2026, 1, 2, 3, 4, 5), 32)


def test_robots(spark):
    body = "User-agent: *\r\nDisallow: /\n\nUser-agent: a\nUser-agent: Bot\nDisallow: /x?\nAllow: /x?y$ # end\nCrawl-delay: 2\nUser-agent: c\nDisallow: /"
    bodies = spark.createDataFrame([("h", body), ("n", None), ("bad", "Disallow: /"), ("e", "")], "host string, body string")
    rules = robots.robots_rules(bodies, "bot")
    assert {r.host: (r.available, r.delay, len(r.rules)) for r in rules.collect()} == {"h": (True, 2.0, 2), "n": (False, None, 0), "bad": (False, None, 0), "e": (True, 0.0, 0)}
    asked = ["https://h/", "https://h/x?", "https://h/x?y", "https://h/x?yz", "https://e/q", "https://bad/", "https://unknown/"]
    got = {r.url: r.allowed for r in robots.robots_allowed(spark.createDataFrame([(u,) for u in asked], "url string"), rules).collect()}
    assert [got[u] for u in asked] == [True, False, True, False, True, None, None]


def test_links(spark):
    base, cases = "https://e.org/a/b?c=1", {"../d": "https://e.org/d", "https://x.org/y": "https://x.org/y", "mailto:a@b": None, "//z.org": "https://z.org", "?q": "https://e.org/a/b?q", "https://x.org/a/../b": "https://x.org/a/../b"}
    rows = spark.createDataFrame([(h,) for h in [*cases, None]], "href string").select("href", content.resolve_url(F.lit(base), F.col("href")).alias("to")).collect()
    assert {r.href: r.to for r in rows} == {**cases, None: None}


def test_streak():
    at, now, seen = iter(range(9)), (0, None, None), []
    for category, code in [("extraction", "x"), ("extraction", "x"), ("extraction", "x"), ("extraction", "x"), ("blocked", "captcha"), ("retry", "t"), ("ok", None)]:
        now = streak_step(now, (next(at), category, code))
        seen.append(now)
    assert seen[2:] == [(3, "extraction_failed", 2), (4, "extraction_failed", 2), (5, "captcha", 4), (6, "captcha", 4), (0, None, None)]


def test_streak_stream_equals_its_steps(spark, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    kinds = [("extraction", "x"), ("blocked", "captcha"), ("extraction", "x"), ("extraction", "x"), ("ok", None), ("retry", "t")]
    rows = [(i, i % 2, start + datetime.timedelta(minutes=i), *kinds[(i * i) % 6]) for i in range(20)]
    schema = "id long, source_id long, finished_at timestamp, category string, error_code string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = failure_streak_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)
    want, now = {}, {0: (0, None, None), 1: (0, None, None)}
    for i, source, at, category, code in rows:
        want[i] = now[source] = streak_step(now[source], (at, category, code))
    assert {r.id: (r.failures, r.reason, r.since) for r in spark.table("streaks").collect()} == want
