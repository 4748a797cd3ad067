"""Streams against their batch twins, and replayed batches."""

import datetime
import random

import pytest
from newsloom.operators.alerts import keyword_matches, unique_keywords
from newsloom.operators.merges import merged_articles
from newsloom.streaming.alerts import ALERT, alert_batch, stream_alerts
from newsloom.streaming.batches import written_before
from newsloom.streaming.coalesce import coalesce_stream, coalesced_within
from newsloom.streaming.ingest import ARTICLE, current_articles, ingest_batch, stream_ingest

AT = datetime.datetime(2026, 1, 5, 12)
ROWS = lambda df: sorted(map(tuple, df.collect()), key=repr)


def article(external_id, url, title, level, content=None, **more):
    row = {"source_id": 1, "external_id": external_id, "url": url, "title": title, "content": content, "content_level": level, "author": None, "image_url": None, "language": "fr", "published_at": None, "processed": None, "id": None} | more
    return tuple(row[c] for c in ARTICLE.names)


def test_keywords_brute_force(spark):
    rnd = random.Random(8)
    letters = ["a", "b", "É", "日", " ", "İ", "x"]
    texts = [(i, *("".join(rnd.choices(letters, k=rnd.randint(0, 60))) if rnd.random() > 0.1 else None for _ in range(2))) for i in range(80)] + [(99, "n" * 3000 + "needle in the hay", None)]
    words = [(u, s, "".join(rnd.choices(letters[:6], k=rnd.randint(0, 20 if s == 0 else 4)))) for u in range(12) for s in range(5)] + [(50, 1, "NEEDLE in the HAY"), (50, 2, "n" * 40), (51, 1, "needle in the hay!")]
    articles = spark.createDataFrame(texts, "article_id long, title string, body string").repartition(3)
    subs = spark.createDataFrame(words, "user_id long, subscription_id long, keyword string")
    lowered = {(w,): None for _, _, w in words}
    low = {r.k: r.l for r in spark.createDataFrame(list(lowered), "k string").selectExpr("k", "lower(k) l").collect()}
    told = {r.article_id: (r.a, r.b) for r in articles.selectExpr("article_id", "lower(title) a", "lower(body) b").collect()}
    want = {}
    for user, sub, word in sorted(words, key=lambda w: w[1]):
        for i, fields in told.items():
            if word and any(low[word] in (t or "") for t in fields):
                want.setdefault((user, i), word)
    got = {(r.user_id, r.article_id): r.keyword for r in keyword_matches(subs, articles, ("title", "body")).collect()}
    assert got == want
    recent = articles.selectExpr("*", "timestamp'2026-01-05 12:00:00' - make_interval(0, 0, 0, 0, article_id) as crawled_at")
    near = {k: w for k, w in want.items() if k[1] <= 24}
    assert {(r.user_id, r.article_id): r.keyword for r in keyword_matches(subs, recent, ("title", "body"), AT).collect()} == near
    assert keyword_matches(subs.limit(0), articles, ("title",)).count() == 0 and keyword_matches(subs, articles.limit(0), ("title",)).count() == 0


def test_new_keywords(spark):
    lists = spark.createDataFrame([(1, " a, b,a,,c ,d"), (2, "a"), (3, None)], "user_id long, keywords string")
    stored = spark.createDataFrame([(1, "b"), (1, "z"), (9, "a")], "user_id long, keyword string")
    assert ROWS(unique_keywords(lists, most=4, stored=stored)) == [(1, "a"), (1, "c"), (2, "a")]
    assert ROWS(unique_keywords(lists, most=2)) == [(1, "a"), (1, "b"), (2, "a")]


def test_merged_articles(spark):
    schema = "id long, source_id long, external_id string, url string, title string, title_zh string, content string, content_level string, author string, processed boolean, summary_fr string"
    stored = [(1, 1, "a", "u/a", "A", "甲", None, "metadata_only", "X", True, "s"), (2, 1, "b", "u/b", "B", "乙", "long", "full", None, True, "s"), (3, 2, "c", "u/c", "C", None, None, "excerpt", None, True, None)]
    incoming = [(1, "a", "u/a", "A", "body", "full", None), (1, "b", "u/b", "B2", "more", "full", "Y"), (1, "n", "u/n", "N", None, "excerpt", "Z"), (2, "c", "u/other", "C", "x", "full", None), (2, "d", "u/d", "D", None, "excerpt", None)]
    made = merged_articles(spark.createDataFrame(stored, schema), spark.createDataFrame(incoming, "source_id long, external_id string, url string, title string, content string, content_level string, author string"))
    assert ROWS(made) == [(1, 1, "a", "u/a", "A", "甲", "body", "full", "X", False, None, "updated"), (None, 1, "n", "u/n", "N", None, None, "excerpt", "Z", False, None, "new")]


def test_ingest_and_replay(spark, tmp_path):
    store = str(tmp_path / "store")
    batches = [
        [article("a", "u/a", "A", "metadata_only", author="X"), article("b", "u/b", "B", "full", "text"), article("a", "u/a", "A better", "excerpt", "short")],
        [article("a", "u/a", "A full", "full", "body"), article("b", "u/b", "no", "excerpt", "t"), article("c", "u/c", "C", "metadata_only")],
    ]
    frames = [spark.createDataFrame(b, ARTICLE) for b in batches]
    for n, frame in enumerate(frames):
        ingest_batch(frame, n, store)
    want = {("a", "A full", "full"), ("b", "B", "full"), ("c", "C", "metadata_only")}
    brief = lambda: {(r.external_id, r.title, r.content_level) for r in current_articles(spark, store).collect()}
    assert brief() == want
    before = ROWS(written_before(spark, store, ARTICLE))
    for n, frame in reversed(list(enumerate(frames))):  # replayed, even out of order
        ingest_batch(frame, n, store)
    assert ROWS(written_before(spark, store, ARTICLE)) == before

    source, streamed = str(tmp_path / "in"), str(tmp_path / "streamed")
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(source)
        query = stream_ingest(spark.readStream.schema(ARTICLE).parquet(source), streamed, str(tmp_path / "check"))
        assert query.awaitTermination(120)
    assert ROWS(current_articles(spark, streamed)) == ROWS(current_articles(spark, store))


def test_alerts_once(spark, tmp_path):
    schema = "article_id long, crawled_at timestamp, title string, body string"
    subs = spark.createDataFrame([(1, 1, "chip"), (1, 2, "laser"), (2, 3, "laser")], "user_id long, subscription_id long, keyword string")
    hours = lambda h: AT + datetime.timedelta(hours=h)
    batches = [
        [(1, hours(0), "New chip", None), (2, hours(0), "Nothing", "at all"), (1, hours(0), "New chip", None)],
        [(1, hours(1), "New chip", "with a LASER"), (2, hours(1), "Nothing", "at all")],
        [(1, hours(60), "New chip", "with a laser again")],
    ]
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = stream_alerts(spark.readStream.schema(schema).parquet(source), subs, store, str(tmp_path / "check"), ("title", "body"))
        assert query.awaitTermination(120)
    told = [(r.user_id, r.article_id, r.keyword, r.crawled_at) for r in written_before(spark, store, ALERT).collect()]
    assert sorted(told) == sorted([(1, 1, "chip", hours(0)), (2, 1, "laser", hours(1)), (1, 1, "chip", hours(60)), (2, 1, "laser", hours(60))])
    before = ROWS(written_before(spark, store, ALERT))
    batch_of = {r.crawled_at: r.batch for r in written_before(spark, store, ALERT).collect()}
    alert_batch(spark.createDataFrame(batches[1], schema), batch_of[hours(1)], subs, ("title", "body"), store, 24)
    assert ROWS(written_before(spark, store, ALERT)) == before


@pytest.mark.parametrize("parts", [1, 4])
def test_coalescing_stream(spark, tmp_path, parts):
    rnd = random.Random(parts)
    events = sorted((AT + datetime.timedelta(minutes=rnd.randint(0, 3000)), rnd.randint(0, 5), rnd.random() < 0.2) for _ in range(120))
    rows = [(i, entity, at, finish) for i, (at, entity, finish) in enumerate(events)]
    schema = "id long, entity_id long, created_at timestamp, finish boolean"
    batch = spark.createDataFrame(rows, schema)
    want, open_jobs = [], {}
    for i, entity, at, finish in rows:
        job = open_jobs.get(entity)
        if finish:
            open_jobs.pop(entity, None)
        elif job and at < job[1]:
            want.append((i, entity, job[0], True))
        else:
            open_jobs[entity] = (i, at + datetime.timedelta(hours=3))
            want.append((i, entity, i, False))
    assert ROWS(coalesced_within(batch, 3 * 3600)) == sorted(want, key=repr)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = str(tmp_path / "in")
        last = [(1000, 9, AT + datetime.timedelta(days=9), True)]
        for n in range(parts):
            spark.createDataFrame(rows[n * 120 // parts : (n + 1) * 120 // parts] + (last if n == parts - 1 else []), schema).coalesce(1).write.mode("append").parquet(source)
        query = coalesce_stream(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(source), 3 * 3600).writeStream.format("memory").queryName(f"coalesced_{parts}").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.table(f"coalesced_{parts}")
    assert ROWS(told.where("not expired").drop("expired")) == sorted(want, key=repr)
    left = sorted((entity, job) for entity, (job, _) in open_jobs.items())
    assert left == [x for x in left if x in {(r.entity_id, r.job_id) for r in told.where("expired").collect()}]
