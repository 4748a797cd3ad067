"""Each query of the library's own operators against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from newsloom.plans.queries import QUERIES, SQL

SF = os.environ.get("NEWSLOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert got == sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_bad_dates_set_no_limit(spark):
    from pyspark.sql import functions as F

    from newsloom.operators.articles import day_range

    rows = spark.createDataFrame([(datetime.datetime(2026, 1, d, 23, 59, 59),) for d in (1, 2, 3)], "t timestamp")
    assert rows.where(day_range(F.col("t"), "2026-01-02", "not a date")).count() == 2
    assert rows.where(day_range(F.col("t"), None, "2026-01-02")).count() == 2


def test_stream_and_batch_agree(spark, tmp_path):
    from newsloom.plans import adapters
    from newsloom.streaming.usage import usage_windows

    batch = adapters.usage(spark, SF)
    batch.write.parquet(str(tmp_path / "usage"))
    stream = usage_windows(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "usage")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("usage_windows").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.task_type)
    assert sorted(spark.table("usage_windows").collect(), key=key) == sorted(usage_windows(batch).collect(), key=key)
