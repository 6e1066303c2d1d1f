import random

import pytest
from builders import Log, fact, ids, node
from fold import replay as fold_replay
from fold import view as fold_view

from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.errors import ConflictingFact, InvalidReplay, MissingEntity
from palimpsest.operators import replay, view
from palimpsest.operators.view import Clock, Projection
from palimpsest.sources import storage


def test_late_supersession(spark):
    log = Log().node(5, "a").node(5, "b").fact(20, "old", "a", "r", "b", valid_from=10).fact(50, "new", "a", "r", "b", valid_from=30, supersedes="old")
    p = replay.replay(log.frame(spark)).projection
    assert ids(p.view(40, 40).facts) == ["old"]
    assert ids(p.view(40, 60).facts) == ["new"]
    assert ids(p.view(1, 1).facts) == [] and ids(p.view(1, 1).nodes) == []
    assert [tuple(r) for r in p.superseded_by.collect()] == [("old", "new")]


def test_retraction_and_overwriting(spark):
    log = Log().node(5, "a").node(5, "b").fact(20, "f", "a", "r", "b", valid_from=10).retract(50, "f", 30)
    p = replay.replay(log.frame(spark)).projection
    assert ids(p.view(40, 40).facts) == ["f"] and ids(p.view(40, 60).facts) == []
    again = replay.replay(log.retract(90, "f", 35).frame(spark)).projection
    # The later retraction replaces the earlier one, so between the two the fact lives again.
    assert ids(again.view(40, 60).facts) == ["f"] and ids(again.view(40, 95).facts) == []


def test_errors_of_replay(spark):
    with pytest.raises(MissingEntity):
        replay.replay(Log().node(1, "a").fact(2, "f", "a", "r", "b").frame(spark))
    twice = Log().node(1, "a").fact(2, "f", "a", "r", "a").fact(3, "g", "a", "r", "a", supersedes="f").fact(4, "h", "a", "r", "a", supersedes="f")
    with pytest.raises(ConflictingFact):
        replay.replay(twice.frame(spark))
    with pytest.raises(InvalidReplay):
        replay.replay(Log().node(1, "a").node(1, "b").frame(spark).filter("global_position = 1"))


def test_resume_equals_whole_replay(spark):
    log = Log()
    for i in range(6):
        log.node(i + 1, f"n{i}")
    events = log.fact(9, "f", "n0", "r", "n1").frame(spark)
    head = replay.replay(events.filter("global_position < 3"))
    done = replay.resume(replay.Snapshot(head.cursor, head.projection), events.filter("global_position >= 3"))
    assert done.projection.equals(replay.replay(events).projection)
    with pytest.raises(InvalidReplay):
        replay.resume(replay.Snapshot(head.cursor, head.projection), events.filter("global_position >= 4"))


def test_bulk_build(spark):
    nodes = spark.createDataFrame([node("a"), node("b")], schema.NODE)
    facts = spark.createDataFrame([fact("new", "a", "r", "b", supersedes="old"), fact("old", "a", "r", "b")], schema.FACT)
    p = replay.from_parts(nodes, facts, known_at=7)
    assert ids(p.view(1, 7).facts) == ["new"]
    assert ids(p.view(1, 6).nodes) == []
    assert replay.state_problems(p).isEmpty()
    with pytest.raises(MissingEntity):
        replay.from_parts(nodes.filter("id = 'a'"), facts, 7)


def _random_log(r: random.Random) -> Log:
    log, facts = Log(), []
    for t in range(r.randint(3, 14)):
        what = r.random()
        if what < 0.45:
            log.node(t, f"n{r.randint(0, 3)}", label=f"l{t}")
        elif what < 0.8 or not facts:
            name = f"f{len(facts)}" if r.random() < 0.95 else "f0"
            prior = r.choice(facts) if facts and r.random() < 0.3 else None
            facts.append(name)
            log.fact(t, name, f"n{r.randint(0, 3)}", "r", f"n{r.randint(0, 3)}", valid_from=r.randint(0, 9), valid_until=r.choice([None, 12]), supersedes=prior)
        else:
            log.retract(t, r.choice(facts), r.randint(5, 14))
    return log


def test_random_logs_agree_with_a_fold(spark):
    """The set-based replay stops at the same first error, or gives the same views."""
    r = random.Random(5)
    for _ in range(12):
        log = _random_log(r)
        events = log.frame(spark).cache()
        rows = [row.asDict(recursive=True) for row in events.orderBy("global_position").collect()]
        state, error = fold_replay(rows)
        found = replay.violations(events).orderBy("global_position", "priority").limit(1).collect()
        if error:
            assert (found[0]["global_position"], found[0]["error"]) == error
            continue
        assert not found
        p = replay.replay(events, strict=False).projection
        clock = Clock(r.randint(0, 14), r.randint(0, 14))
        view = p.view(clock.valid_at, clock.known_at)
        seen, live = fold_view(state, clock.valid_at, clock.known_at)
        assert {x["id"]: x["label"] for x in view.nodes.collect()} == seen
        assert set(ids(view.facts)) == live


def test_clocks_beyond_the_bound_are_taken_in_blocks(spark, monkeypatch):
    log = Log().node(1, "a").node(1, "b").fact(2, "f1", "a", "r", "b", valid_from=2).fact(4, "f2", "a", "r", "b", valid_from=3, supersedes="f1").retract(6, "f2", 5)
    p = replay.replay(log.frame(spark)).projection
    clocks = spark.createDataFrame([(f"{v}.{k}", v, k) for v in range(1, 7) for k in range(1, 8)] + [("again", 3, 3)], "name string, valid_at long, known_at long")
    shown = lambda: sorted((r["name"], r["id"]) for r in view.bitemporal_matrix(p, clocks).collect())
    whole = shown()
    assert ("again", "f1") in whole
    monkeypatch.setattr(view, "MAX_CLOCKS", 5)
    assert shown() == whole


def test_tasks_of_checks_and_positions_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """However well rows compress: AQE would put all of these into one task."""
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3 == 0).alias("odd"), F.lit("x" * 200).alias("text"))
    placed = storage.with_positions(rows, ["key"], "at", group="odd", group_name="own")
    out = placed.orderBy("at").collect()
    assert [r.at for r in out] == list(range(4000)) and [r.key for r in out] == sorted(str(n) for n in range(4000))
    for value in (True, False):
        own = [r.own for r in out if r.odd == value]
        assert own == list(range(len(own)))
    facts = spark.range(4000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.lit("hub").alias("source"), F.lit("hub").alias("target"), F.lit(0).cast("long").alias("valid_from"), F.lit(0).cast("long").alias("recorded_at"), F.lit(None).cast("string").alias("supersedes"))
    nodes = spark.createDataFrame([("other",)], "id string")
    gone = facts.select(F.col("id").alias("fact_id"), F.lit(5).cast("long").alias("valid_until"), "recorded_at")
    found = replay.state_problems(Projection(nodes, facts, replay.supersessions_of(facts), gone, None))
    assert [tuple(r) for r in found.collect()] == [("MissingEntity", "hub")]
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 8)" in plan
