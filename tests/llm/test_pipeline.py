"""The pipeline: each stage against its operator's plain form, on a small table."""

import corpus_pipeline
import pytest
from test_decontaminate import brute_force as contaminated
from test_ngram_join import brute_force as components
from test_pack import check
from test_secret_scan import base

from palimpsest.llm import pack, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], DIR), "test-stage"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(sorted(s.dtypes) == sorted(stages[0].dtypes) for s in stages[:5])


def test_toxic_documents_go(spark, stages):
    scored = toxicity.score(stages[0], spark.read.parquet(f"{DIR}/labels.parquet")).collect()
    assert ids(stages[1]) == {r.doc_id for r in scored if not r.predicted}


def test_one_of_each_component_stays(stages):
    assert ids(stages[2]) == {c for *_, c in components(texts(stages[1]))}


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert ids(stages[3]) == ids(stages[2]) - {d for d, _ in contaminated(texts(stages[2]), items)}


def test_secrets_are_masked_and_no_document_goes(stages):
    assert ids(stages[4]) == ids(stages[3])
    before = dict(texts(stages[3]))
    for doc_id, text in texts(stages[4]):
        assert not base(text) and (text == before[doc_id] or "[SECRET]" in text)
        assert not base(before[doc_id]) or text != before[doc_id]


def test_all_that_stays_is_packed(spark, stages):
    used, bound = check(texts(stages[4]), stages[5].collect(), pack.CAPACITY)
    assert used <= bound + 1
    assert sorted(map(str, corpus_pipeline.run(spark, DIR).drop("sequence_id", "offset").collect())) == sorted(map(str, stages[5].drop("sequence_id", "offset").collect()))


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    """Of a doc_id, or of none, only the rows that are toxic or contaminated themselves go."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    verdict = lambda docs, labels, carry=(): docs.selectExpr("doc_id", "int(text = 'foul') AS predicted", *carry)
    monkeypatch.setattr(toxicity, "score", verdict)
    scored = [(None, "foul"), (None, "fine"), (-5, "foul"), (-5, "fine"), (-6, None)]
    kept = corpus_pipeline.toxicity_stage(spark, spark.createDataFrame(scored, docs.schema), DIR)
    assert sorted(map(str, texts(kept))) == sorted(map(str, [(None, "fine"), (-5, "fine"), (-6, None)]))
    leaked = [(None, item), (None, "clean words"), (-5, item), (-5, "clean words"), (-6, None)]
    kept = corpus_pipeline.benchmark_stage(spark, spark.createDataFrame(leaked, docs.schema), DIR)
    assert sorted(map(str, texts(kept))) == sorted(map(str, [(None, "clean words"), (-5, "clean words"), (-6, None)]))


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []
