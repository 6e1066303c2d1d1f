"""Toxicity: held-out accuracy, and results for odd inputs."""

import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toxicity

DIR = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    return toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").toPandas()


def test_fold_and_shape(scored):
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()


def test_held_out_accuracy(scored):
    test = scored[scored.held_out & scored.toxic.notna()]
    good, bad = test[test.toxic == 0].score, test[test.toxic == 1].score
    auc = sum((bad > g).mean() + (bad == g).mean() / 2 for g in good) / len(good)
    assert auc >= 0.95 and (good >= 0.5).mean() <= 0.01 and (bad >= 0.5).mean() >= 0.8


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda t: sorted((r.doc_id, r.score) for r in toxicity.score(docs, t).collect())
    assert scores(labels) == scores(turned)


def test_odd_inputs(spark):
    rows = [(i, "you are a worthless idiot and trash" if i % 3 == 0 else "the harbour was quiet in the morning") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(5, 0), (None, 1), (7, None)], LABELS)
    more = [(1, "twice"), (1, "twice"), (None, None), (1000, ""), (1001, None), (1002, "y0u 1d10t " * 50_000)]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows + more], DOCS + ", score double").withColumn("features", F.lit(1))
    found = toxicity.score(docs, labels).collect()
    assert len(found) == 96 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (None, 1000, 1001)}) == 1
    assert {r.predicted for r in found if r.doc_id in range(0, 90, 3)} == {1}
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    assert toxicity.score(spark.createDataFrame([], DOCS), labels).collect() == []
    alone = toxicity.score(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in alone} == {0.0}


def test_disguised_words_are_seen():
    matcher = toxicity.build_matcher({"idiot": 2.0})
    at = toxicity.NAMES.index("disguised")
    for text in ("you 1d1ot", "you i.d.i.o.t", "you idiiiot"):
        assert toxicity.features(text, matcher)[at] == 1, text
    assert toxicity.features("you went out", matcher)[at] == 0
