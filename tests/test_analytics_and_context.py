import random

import pytest
from builders import Log, ids
from pyspark.sql import functions as F

from palimpsest.errors import BudgetTooSmall, InvalidValue, MissingEntity
from palimpsest.operators import analytics, context, graph, replay, retrieval
from palimpsest.operators.view import Clock


@pytest.fixture(scope="module")
def memory(spark):
    log = Log()
    for name, kind in (("d", "decision"), ("i", "inference"), ("a", "file"), ("b", "file"), ("c", "file"), ("lone", "file")):
        log.node(1, name, kind=kind)
    log.fact(2, "p1", "a", "policy", "b", confidence=9000)
    for n, target in ((2, "c"), (3, "b"), (4, "c")):
        log.fact(n + 1, f"p{n}", "a", "policy", target, confidence=9000, supersedes=f"p{n - 1}")
    log.fact(6, "dup1", "b", "uses", "c", confidence=7000).fact(7, "dup2", "b", "uses", "c", confidence=8000)
    log.fact(8, "weak", "c", "supports", "i", confidence=1000).fact(9, "says", "i", "leads_to", "d")
    return replay.replay(log.frame(spark)).projection


def test_drift(memory):
    snapshots, summary = analytics.drift(memory, 10, "a", "policy")
    assert [r["change"] for r in snapshots.orderBy("recorded_at").collect()] == ["initial", "corrected", "corrected", "corrected"]
    row = summary.first()
    assert (row["correction_count"], row["stability_bps"], row["likely_to_change"]) == (3, 4000, True)


def test_gaps(memory):
    gaps, health = analytics.reasoning_gaps(memory, Clock(10, 10), 2, 2000, 3, 1_000_000, 50)
    kinds = {(r["entity"], r["kind"]): r for r in gaps.collect()}
    assert kinds["d", "unjustified_decision"]["severity_bps"] == 10_000
    assert kinds["i", "single_source_inference"]["severity_bps"] == 5000
    assert kinds["i", "low_confidence_foundation"]["fact"] == "weak"
    assert kinds["a", "unstable_knowledge"]["fact"] == "p4"
    assert kinds["a", "unstable_knowledge"]["downstream_entities"] == 3
    assert health.first()["analyzed_entities"] == 6
    with pytest.raises(InvalidValue):
        analytics.reasoning_gaps(memory, Clock(10, 10), 0, 0, 2, 0, 1)


def test_consolidation(memory):
    actions, summary = analytics.consolidation_plan(memory, Clock(10, 10), 10)
    rows = [(r["kind"], r["keep"], r["affected_facts"], r["affected_entities"]) for r in actions.collect()]
    assert rows == [
        ("supersede_duplicate", "dup2", ["dup2", "dup1"], ["b", "c"]),
        ("review_orphan", None, [], ["lone"]),
        ("compact_revision_chain", "p4", ["p1", "p2", "p3", "p4"], ["a"]),
    ]
    assert summary.first()["projected_savings"] == 4


def test_belief(memory):
    hypothesis = {"source": "a", "relation": "policy", "target": "b", "confidence": 6000, "supersedes": None}
    found, cascade, decisions = analytics.belief_revision(memory, hypothesis, Clock(10, 10), 5)
    assert [(r["fact"], r["strength_bps"]) for r in found.collect()] == [("p4", 6000)]
    assert {r["entity"]: (r["depth"], r["revised_confidence_bps"]) for r in cascade.collect()} == {"c": (0, 7000), "i": (1, 8000), "d": (2, 8500)}
    assert [r["entity"] for r in decisions.collect()] == ["d"]


def test_graph(memory):
    vertices, edges = graph.project_graph(memory.view(10, 10))
    assert vertices.count() == 6 and edges.count() == 5
    levels = {r["f"]: r["l"] for r in edges.select(F.col("attributes")["fact_id"].alias("f"), F.col("provenance.confidence").alias("l")).collect()}
    assert levels == {"p4": "high", "dup1": "medium", "dup2": "high", "weak": "low", "says": "exact"}
    assert ids(graph.orphans(memory.view(10, 10))) == ["lone"]
    roots = memory.facts.sparkSession.createDataFrame([("a",)], "entity string")
    assert graph.reachable_counts(memory.view(10, 10).facts, roots).first()["n"] == 3


def test_triangle_keeps_boundary_edges(spark):
    log = Log().node(1, "a").node(1, "b").node(1, "c").fact(2, "ab", "a", "r", "b").fact(2, "ac", "a", "r", "c").fact(2, "bc", "b", "r", "c")
    p = replay.replay(log.frame(spark)).projection
    bundle = context.compile_context(p, context.ContextRequest(("a",), 5, 5, 10_000, max_depth=1))
    assert ids(bundle.nodes) == ["a", "b", "c"] and ids(bundle.facts) == ["ab", "ac", "bc"]
    receipt = bundle.receipt.first()
    assert (receipt["selected_facts"], receipt["omitted_by_budget"]) == (3, 0)


def test_budgets_and_scope(spark):
    log = Log().node(1, "t", kind="task", branch="main", repository="x").node(1, "f", branch="main", repository="x").node(1, "g", branch="release", repository="x")
    log.fact(2, "tf", "t", "affects", "f").fact(2, "tg", "t", "affects", "g")
    p = replay.replay(log.frame(spark)).projection
    scoped = context.ContextRequest(("t",), 5, 5, 200, branches=("main",))
    bundle = context.compile_context(p, scoped)
    assert ids(bundle.nodes) == ["f", "t"] and bundle.receipt.first()["excluded_by_scope"] == 1
    with pytest.raises(BudgetTooSmall):
        context.compile_context(p, context.ContextRequest(("t",), 5, 5, 1))
    with pytest.raises(MissingEntity):
        context.compile_context(p, context.ContextRequest(("g",), 5, 5, 100, branches=("main",)))
    small = context.compile_context(p, context.ContextRequest(("t",), 5, 5, 30), bytes_per_token=1)
    assert small.receipt.first()["omitted_by_budget"] == 2 and ids(small.nodes) == ["t"]


def greedy(facts, costs, seeds, budget):
    taken, used = set(seeds), sum(costs[s] for s in seeds)
    if used > budget:
        return {("required", str(used))}
    out = set()
    for id_, source, target, _, _, _, tokens in sorted(facts, key=lambda f: (f[3], -f[4], -f[5], f[0])):
        price = tokens + sum(costs[e] for e in (source, target) if e not in taken)
        out.add(("fact" if used + price <= budget else "omitted", id_))
        if used + price <= budget:
            used += price
            taken |= {source, target}
    return out | {("node", e) for e in taken} | {("used", str(used))}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_packing_in_rounds_equals_the_chain(spark, monkeypatch, chunk):
    """A hub that all facts touch, self-loops, facts too dear at once or later, many requests."""
    monkeypatch.setattr(context, "CHUNK", chunk)
    monkeypatch.setattr(context, "SHARES", 2)
    monkeypatch.setattr(context, "fact_tokens", lambda n: F.col("tokens"))
    pick = random.Random(7)
    costs = {f"n{i}": pick.choice((1, 2, 5, 9, 40)) for i in range(30)}
    facts, seeds, budgets = {}, {}, {}
    for request, budget in enumerate((0, 12, 25, 60, 200)):
        ends = [("n0", f"n{pick.randrange(30)}") if i % 3 else (f"n{pick.randrange(30)}",) * 2 for i in range(40)]
        facts[request] = [(f"f{i}", s, t, pick.randrange(3), pick.randrange(2), pick.randrange(3), pick.choice((1, 3, 4, 30))) for i, (s, t) in enumerate(ends)]
        seeds[request], budgets[request] = ["n0", "n1"], budget
    rows = [(r, *f) for r, fs in facts.items() for f in fs]
    candidates = spark.createDataFrame(rows, "request bigint, id string, source string, target string, distance int, confidence int, recorded_at bigint, tokens bigint")
    tokens = spark.createDataFrame(list(costs.items()), "id string, tokens bigint")
    starts = spark.createDataFrame([(r, s) for r, ss in seeds.items() for s in (*ss, ss[0])], "request bigint, entity string")
    found = context.pack(candidates, tokens, starts, spark.createDataFrame(list(budgets.items()), "request bigint, budget bigint")).collect()
    assert len(found) == len(set(found))
    for request in facts:
        assert {(r["kind"], r["id"]) for r in found if r["request"] == request} == greedy(facts[request], costs, seeds[request], budgets[request])


def test_no_task_of_a_hub_holds_all_its_facts(spark, monkeypatch):
    monkeypatch.setattr(context, "CHUNK", 50)
    hub = spark.range(5000).select(
        F.lit(0).cast("long").alias("request"), F.concat(F.lit("f"), "id").alias("id"), F.lit("hub").alias("source"), F.concat(F.lit("n"), "id").alias("target"),
        F.lit(1).alias("distance"), F.lit(1).alias("confidence"), F.lit(0).cast("long").alias("recorded_at"),
    )
    monkeypatch.setattr(context, "fact_tokens", lambda n: F.lit(20).cast("long"))
    tokens = hub.select(F.col("target").alias("id"), F.lit(10).cast("long").alias("tokens")).union(spark.createDataFrame([("hub", 10)], "id string, tokens bigint"))
    held = []
    first = context._first
    monkeypatch.setattr(context, "_first", lambda live: held.append(first(live).count()) or first(live))
    found = context.pack(hub, tokens, spark.createDataFrame([(0, "hub")], "request bigint, entity string"), spark.createDataFrame([(0, 3100)], "request bigint, budget bigint"))
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    assert counts == {"fact": 103, "omitted": 4897, "node": 104, "used": 1} and max(held) <= 50


def test_fusion(spark):
    hits = spark.createDataFrame(
        [("lex", "task", "lexical", 900), ("lex", "file", "lexical", 800), ("lex", "task", "literal", 700), ("sem", "file", "semantic", 9), ("sem", "task", "semantic", 8)],
        "provider string, entity string, channel string, score bigint",
    )
    rows = retrieval.fuse(hits, 5).collect()
    assert [r["entity"] for r in rows] == ["file", "task"] and rows[0]["fused_score"] == rows[1]["fused_score"] == 1_000_000_000 // 61 + 1_000_000_000 // 62
    assert [r["entity"] for r in retrieval.fuse(hits, 5, ("semantic",)).collect()] == ["file", "task"]


def test_retrieval_seeds_a_context(spark):
    log = Log().node(1, "n1", label="spark plan").node(1, "n2", label="other").fact(2, "f", "n1", "r", "n2")
    p = replay.replay(log.frame(spark)).projection
    texts = p.visible_nodes(5).select(F.col("id").alias("entity"), F.col("label").alias("text"))
    query = retrieval.RetrievalQuery("spark", 3)
    for provider in (retrieval.LiteralProvider(texts), retrieval.Bm25Provider(texts)):
        bundle = context.compile_with_retrieval(p, context.ContextRequest(("-",), 5, 5, 500), query, [provider])
        assert ids(bundle.nodes) == ["n1", "n2"] and [r["entity"] for r in bundle.retrieval.collect()] == ["n1"]
    with pytest.raises(InvalidValue):
        retrieval.fuse_retrieval([retrieval.LiteralProvider(texts), retrieval.LiteralProvider(texts)], query)


def test_nearest_vectors_equal_all_pairs_without_a_row_for_each_pair(spark):
    r = random.Random(5)
    vectors = [(n, [r.choice((-1.0, 0.5, 1.0, 2.0)) for _ in range(3)]) for n in range(300)] + [(300, None), (301, [1.0, None, 2.0]), (302, [1.0])]
    e = spark.createDataFrame(vectors, "id bigint, vector array<double>").repartition(3)
    asked = e.filter("id % 50 = 0 AND id < 300").select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    found = retrieval.nearest(e, asked, 4)
    pairs = e.join(asked).select("query_id", "id", F.round(retrieval.cosine(F.col("asked"), F.col("vector")) * 1_000_000).cast("long").alias("score"))
    want = {}
    for q, i, s in sorted(map(tuple, pairs.filter("score IS NOT NULL").collect()), key=lambda t: (t[0], -t[2], t[1])):
        want.setdefault(q, []).append((q, i, s))
    assert sorted(map(tuple, found.collect())) == sorted(t for own in want.values() for t in own[:4])
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
