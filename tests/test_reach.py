"""Strong components and reach against plain traversals."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import analytics, graph


def reached(edges, root):
    out, todo = {root}, [root]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in out:
                out.add(b)
                todo.append(b)
        todo.pop(0)
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


#: Two cycles that share a node, a cycle behind them, chains into and out of cycles, a self-loop, repeated edges, a lone pair.
KNOTS = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e"), ("in", "a"), ("start", "in"), ("g", "out"), ("out", "end"), ("s", "s"), ("s", "a"), ("a", "b"), ("x", "y")]


def random_edges(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    return [(rng.choice(names), rng.choice(names)) for _ in range(rng.choice([10, 18, 26]))]


@pytest.mark.parametrize("edges", [KNOTS, random_edges(1), random_edges(2)], ids=["knots", "random1", "random2"])
def test_components_and_counts(spark, edges):
    names = sorted({x for e in edges for x in e})
    reach = {n: reached(edges, n) for n in names}
    parts = {r["entity"]: r["component"] for r in graph.strong_components(frame(spark, edges)).collect()}
    assert set(parts) == set(names)
    for a in names:
        for b in names:
            assert (parts[a] == parts[b]) == (b in reach[a] and a in reach[b])
    roots = spark.createDataFrame([(n,) for n in [*names[::2], "unknown", names[0]]], "entity string")
    got = {r["entity"]: r["n"] for r in graph.reachable_counts(frame(spark, edges), roots).collect()}
    assert got == {**{n: len(reach[n]) - 1 for n in names[::2]}, "unknown": 0}


def test_nothing_to_reach(spark):
    assert graph.strong_components(frame(spark, [])).isEmpty()
    assert graph.reachable_counts(frame(spark, [("a", "b")]), frame(spark, []).select(F.col("source").alias("entity"))).isEmpty()


def test_rows_stay_below_roots_by_components(spark, monkeypatch):
    """A ring of 40 behind 30 roots, and a tail: each root has three rows of pairs, not 45."""
    edges = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [(f"root{i}", f"r{i}") for i in range(30)] + [("r7", "t1"), ("t1", "t2")]
    seen, real = [], graph.spread

    def watched(roots, steps, depth, allowed=None):
        seen.append(real(roots, steps, depth, allowed))
        return seen[-1]

    monkeypatch.setattr(graph, "spread", watched)
    roots = spark.createDataFrame([(f"root{i}",) for i in range(30)] + [(f"r{i}",) for i in range(10)], "entity string")
    got = {r["entity"]: r["n"] for r in graph.reachable_counts(frame(spark, edges), roots).collect()}
    assert got == {**{f"root{i}": 42 for i in range(30)}, **{f"r{i}": 41 for i in range(10)}}
    # The last closure is the one over pairs: 30 roots with four components each, and the ring with three for all its roots.
    assert seen[-1].count() == 30 * 4 + 3
    assert max(df.count() for df in seen) < 40 * 45


def test_only_contending_gaps_are_roots(spark):
    rows = [(f"e{i}", f"f{i}", "stale_evidence", severity) for i, severity in enumerate([10_000] * 3 + [9000] * 5 + [100] * 50)]
    gaps = spark.createDataFrame(rows, "entity string, fact string, kind string, severity_bps int")
    assert analytics.contenders(gaps, 3).count() == 3
    assert analytics.contenders(gaps, 4).count() == 8
    assert analytics.contenders(gaps, 9).count() == 58
    assert analytics.contenders(gaps, 1000).count() == 58
    assert analytics.contenders(gaps.limit(0), 5).count() == 0
