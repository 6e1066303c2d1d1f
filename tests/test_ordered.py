"""Work in a total order against plain loops: as-of lookups and drift, with all rows in one group."""

import random

import pytest
from builders import Log
from pyspark.sql import functions as F

from palimpsest.operators import analytics, replay
from palimpsest.operators.view import visible_as_of
from palimpsest.sources import ordered
from palimpsest.sources.ordered import carried, in_order


@pytest.fixture(autouse=True)
def _several_ranges(spark):
    """Spark would make one partition of so few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_carried(spark, hot):
    rng = random.Random(int(hot * 10) + 1)
    rows = [("hot" if rng.random() < hot else f"k{rng.randrange(40)}", i, rng.randrange(100) if rng.random() < 0.3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    kept = in_order(df, ["k"], ["t"])
    assert kept.select("_part").distinct().count() == 4
    want, last = {}, {}
    for k, t, v in sorted(rows):
        want[k, t] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {(r["k"], r["t"]): r["_carried"] for r in carried(kept, ["k"], F.col("v")).collect()} == want


def test_carried_over_partitions_without_a_value(spark):
    """One value at the very beginning of a group that fills all partitions, and a group behind it without one."""
    rows = [("a", i, 7 if i == 0 else None) for i in range(200)] + [("b", i, None) for i in range(3)]
    got = carried(in_order(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], ["t"]), ["k"], F.col("v"))
    assert {(r["k"], r["t"]): r["_carried"] for r in got.collect()} == {(k, t): 7 if k == "a" and t else None for k, t, _ in rows}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, t int, v int")
    assert carried(in_order(empty, ["k"], ["t"]), ["k"], F.col("v")).isEmpty()


def test_visible_as_of(spark):
    """Ties at one instant go to the later position; before its first revision an entity has none; a request for an
    unknown entity stays, with nulls; one entity has most of the rows."""
    rng = random.Random(3)
    revisions = [("hot" if rng.random() < 0.7 else f"e{rng.randrange(8)}", "file", f"l{i}", None, None, {"n": str(i)}, rng.randrange(1, 60), i) for i in range(150)]
    requests = [(i, rng.choice(["hot", "hot", "e1", "e5", "unknown", None]), rng.randrange(0, 70)) for i in range(200)]
    frame = spark.createDataFrame(revisions, "id string, kind string, label string, repository string, branch string, attributes map<string,string>, recorded_at bigint, position bigint")
    got = {r["request"]: (r["entity"], r["known_at"], r["label"], r["attributes"]) for r in visible_as_of(frame, spark.createDataFrame(requests, "request bigint, entity string, known_at bigint")).collect()}
    want = {}
    for request, entity, known_at in requests:
        known = [r for r in revisions if r[0] == entity and r[6] <= known_at]
        best = max(known, key=lambda r: (r[6], r[7]), default=None)
        want[request] = (entity, known_at, best[2] if best else None, best[5] if best else None)
    assert got == want


def test_drift_with_all_facts_under_one_pair(spark, monkeypatch):
    """No range holds them all, and the result is that of a loop."""
    rng, log = random.Random(8), Log().node(0, "a")
    for name in "xyz":
        log.node(0, name)
    facts = [(f"f{i:03}", rng.choice("xyz"), rng.randrange(1, 40), rng.randrange(0, 10_001)) for i in range(120)]
    for id_, target, at, confidence in facts:
        log.fact(at, id_, "a", "likes", target, confidence=confidence)
    seen, real = [], ordered.in_order
    monkeypatch.setattr(analytics, "in_order", lambda *args: (seen.append(real(*args)), seen[-1])[1])
    snapshots, summary = analytics.drift(replay.replay(log.frame(spark), strict=False).projection, 100)
    before, want = None, {}
    for id_, target, at, confidence in sorted(facts, key=lambda f: (f[2], f[0])):
        if before is None:
            want[id_] = "initial"
        elif target != before[1]:
            want[id_] = "corrected"
        else:
            want[id_] = "reinforced" if confidence > before[3] else "weakened" if confidence < before[3] else "refined"
        before = (id_, target, at, confidence)
    assert {r["fact"]: r["change"] for r in snapshots.collect()} == want
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 60
    assert summary.first()["n"] == 120
