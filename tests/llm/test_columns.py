"""Every stage and operator on awkward columns, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import ann, lm, packing, pieces, pii, quality, simhash, substrings, tokens
from newsloom.llm.queries import tokenizer

EXTRA = ["spans", "kept", "n_words", "__row", "__key", "row", "key", "bands", "at", "a.b"]
PROSE = " ".join(f"the word of place {i} is in a list" for i in range(40))
BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [PROSE, PROSE, PROSE + " and mail a.b@c.example.org", None, "", "one"]
    rows = spark.createDataFrame([(i if i < 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = rows.union(rows.limit(1)).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    for i, c in enumerate(EXTRA):
        rows = rows.withColumn(c, F.lit(i))
    return rows.withColumn("m", F.create_map(F.lit("k"), F.lit("v")))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_other_columns(spark, docs, name, stage):
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and got.drop("text").schema.simpleString() == docs.drop("text").schema.simpleString()
    for r in got.collect():
        assert [r[c] for c in EXTRA] == list(range(len(EXTRA))) and r.m == {"k": "v"}
    assert stage(spark, docs.limit(0), "").count() == 0


def test_operators_on_them(spark, docs):
    assert packing.pack(docs, path=tokenizer(BPE)).count() == docs.count()
    assert tokens.token_counts(docs, tokenizer(BPE)).count() == docs.count()
    assert substrings.remove_repeats(docs).count() == docs.count()
    assert simhash.simhash_components(docs).count() == docs.count()
    assert pieces.round_trip(docs, tokenizer(PIECES)).where("round_trip").count() == docs.count()
    assert quality.quality(docs).count() == docs.count()
    labels = spark.createDataFrame([(0, 1), (None, 1)], "doc_id long, quality int")
    assert lm.score(docs, labels).count() == docs.count()


def test_operators_on_empty_tables(spark, docs):
    none = docs.limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (tokens.token_counts(none, tokenizer(BPE)), lm.score(none, labels), pieces.round_trip(none, tokenizer(PIECES)), pii.digest(pii.find_pii(none)), quality.quality(none), simhash.simhash_components(none), ann.nearest(vectors)):
        assert df.count() == 0
