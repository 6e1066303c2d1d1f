"""The layout for clocks and the lexical index: equal results, and less that is read."""

import random
import re

import pytest
from builders import Log
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue
from palimpsest.operators import lexical_index, replay, retrieval
from palimpsest.operators.lexical_index import IndexedProvider, LexicalIndex
from palimpsest.sources.clustered import ClusteredProjection


@pytest.fixture(scope="module")
def memory(spark):
    rng, log = random.Random(5), Log()
    for i in range(12):
        log.node(rng.choice([0, 0, 40]), f"n{i}")
    for i in range(150):
        at = rng.randrange(1, 100)
        until = at + rng.randrange(1, 50) if rng.random() < 0.4 else None
        log.fact(at + rng.randrange(0, 20), f"f{i}", f"n{rng.randrange(12)}", "likes", f"n{rng.randrange(12)}", valid_from=at, valid_until=until, supersedes=f"f{i - 1}" if i % 3 == 2 else None)
    for i in range(0, 150, 7):
        log.retract(130, f"f{i}", 150 + i)
        if i % 2:
            log.retract(140, f"f{i}", 200)
    return replay.replay(log.frame(spark), strict=False).projection


def files_of(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.mark.parametrize("bits", [0, 3])
def test_clustered_views(spark, memory, tmp_path, bits):
    laid_out = ClusteredProjection.write(memory, f"file://{tmp_path}/state", bits)
    for clock in ((10, 20), (50, 1000), (160, 135)):
        ours, theirs = laid_out.view(*clock), memory.view(*clock)
        columns = theirs.facts.columns
        assert sorted(map(str, ours.facts.select(columns).collect())) == sorted(map(str, theirs.facts.select(columns).collect()))
        assert sorted(map(str, ours.nodes.select(theirs.nodes.columns).collect())) == sorted(map(str, theirs.nodes.collect()))


def test_an_early_clock_reads_a_fraction(spark, memory, tmp_path):
    laid_out = ClusteredProjection.write(memory, f"file://{tmp_path}/state", 3)
    there = len(list(tmp_path.glob("state/facts/cell=*/*.parquet")))
    plan = laid_out.active_facts(15, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    early = laid_out._facts().filter(F.col("cell").isin(laid_out.cells(15, 20)))
    assert 0 < len(files_of(early)) < there / 4
    assert laid_out.cells(-1, 1000) == [] and laid_out.active_facts(-1, 1000).isEmpty()
    with pytest.raises(InvalidValue):
        ClusteredProjection.write(memory, f"file://{tmp_path}/other", 7)


def test_an_empty_projection(spark, memory, tmp_path):
    from palimpsest.operators.view import Projection

    none = Projection(*(t.limit(0) for t in (memory.node_revisions, memory.facts, memory.supersessions, memory.retractions)))
    assert ClusteredProjection.write(none, f"file://{tmp_path}/state").view(10, 10).facts.isEmpty()


def texts(spark, n=300):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i}", " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", None), ("blank", ""), ("other", "É w1, W1! 7")], "entity string, text string")


@pytest.mark.parametrize("query", ["w1 w2 w40", "W1 w1 7 é", "unknown", "w0 w1 w2 w3 w4 w5 w6 w7"])
def test_index_equals_a_scan(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCUMENTS", 8)
    monkeypatch.setattr(lexical_index, "FIRST", 3)
    docs = texts(spark)
    index = LexicalIndex.build(docs, f"file://{tmp_path}/index")
    asked = retrieval.RetrievalQuery(query, 7)
    scan = retrieval.Bm25Provider(docs.withColumn("text", F.coalesce("text", F.lit("")))).retrieve(asked)
    want = [(r["entity"], r["score"]) for r in scan.orderBy(F.desc("score"), "entity").limit(7).collect()]
    assert [(r["entity"], r["score"]) for r in IndexedProvider(index).retrieve(asked).collect()] == want


def test_index_reads_its_terms_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCUMENTS", 8)
    monkeypatch.setattr(lexical_index, "FIRST", 3)
    index = LexicalIndex.build(texts(spark), f"file://{tmp_path}/index")
    postings = index._of("postings", ["w40"])
    buckets = {re.search(r"bucket=(\d+)", f).group(1) for f in files_of(postings)}
    assert len(buckets) == 1 and "EqualTo(term,w40)" in postings._jdf.queryExecution().toString()
    read, real = [], index._scores
    monkeypatch.setattr(index, "_scores", lambda terms, blocks: (read.append(blocks.count()), real(terms, blocks))[1])
    index.search("w40 w41 w1", 3)
    assert sum(read) < index._read("maxima").select("block").distinct().count()
    with pytest.raises(InvalidValue):
        LexicalIndex.build(texts(spark), "x", b=2)


def test_a_build_moves_postings_once(spark, tmp_path):
    """A document's terms are counted where it is read, and maxima of the sorted postings need no exchange."""
    words = texts(spark).select("entity", lexical_index.tokens().alias("words")).withColumn("n", F.size("words"))
    index = LexicalIndex.build(texts(spark), f"file://{tmp_path}/index")
    maxima = lexical_index.run_maxima(index._read("postings"))
    for plan in (lexical_index.counted(words), maxima):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    want = {(r.term, r.block): (r.most, r.n) for r in index._read("postings").groupBy("term", "block").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("n")).collect()}
    found = index._read("maxima").groupBy("term", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n")).collect()
    assert {(r.term, r.block): (r.most, r.n) for r in found} == want


def test_an_empty_index(spark, tmp_path):
    index = LexicalIndex.build(texts(spark).limit(0), f"file://{tmp_path}/index")
    assert index.search("w1", 3).isEmpty()
