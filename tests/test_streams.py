"""The log as a data source, the projection store and folds of one's own."""

import pytest
from builders import Log
from pyspark.errors import StreamingQueryException

from palimpsest.errors import InvalidReplay, InvalidValue, MissingEntity
from palimpsest.operators import replay
from palimpsest.operators.view import _same
from palimpsest.sources.event_log import EventLog, ExpectedVersion
from palimpsest.sources.storage import ship
from palimpsest.streaming import folds, log_source, projection_store
from palimpsest.streaming.projection_store import ProjectionStore

COLUMNS = ["id", "event_type", "occurred_at", "recorded_at", "agent_id", "session_id", "correlation_id", "causation_id", "payload"]


@pytest.fixture(autouse=True)
def _registered(spark):
    ship(spark)
    log_source.register(spark)


def small_log():
    log = Log()
    for name in "abcd":
        log.node(1, name, attributes={"k": name})
    log.node(3, "a", label="a again")
    log.fact(4, "f1", "a", "likes", "b").fact(5, "f2", "a", "likes", "c", supersedes="f1").fact(6, "f3", "b", "likes", "d")
    log.retract(7, "f3", 50).fact(8, "f4", "a", "likes", "d", supersedes="f2").retract(9, "f3", 20)
    return log.node(9, "late")


def stored(spark, tmp_path, log=None, sizes=(5, 4, 3)):
    store, rows, at = EventLog.open(spark, f"file://{tmp_path}/log"), (log or small_log()).frame(spark), 0
    for size in sizes:
        part = rows.filter(f"global_position >= {at} AND global_position < {at + size}")
        store.append("s", ExpectedVersion.ANY, part.select(*COLUMNS), ("recorded_at", "id"))
        at += size
    return store


def test_log_as_a_table(spark, tmp_path):
    log = stored(spark, tmp_path)
    assert _same(flat(spark.read.format("event_log").option("path", log.path).load()), flat(log.events()))
    part = spark.read.format("event_log").option("path", log.path).option("after", 2).option("upto", 6).load()
    assert sorted(r[0] for r in part.select("global_position").collect()) == [3, 4, 5, 6]
    # Of the twelve events' batches only those of the range are read.
    assert {p.file.split("/")[-2][:8] for p in log_source.LogFiles(log.path).slices(2, 6)} == {"00000000", "00000001"}
    assert log_source.LogFiles(log.path).slices(11, 99) == []
    empty = EventLog.open(spark, f"file://{tmp_path}/empty")
    assert spark.read.format("event_log").option("path", empty.path).load().isEmpty()


def flat(events):
    from palimpsest.operators.view import _comparable

    return _comparable(events.selectExpr("id", "stream_version", "global_position", "to_json(payload) AS payload"))


def test_offsets_and_admission(spark, tmp_path):
    """Micro-batches end where max_events says, not where the log's batches do; a restarted reader goes on there."""
    log = stored(spark, tmp_path)
    options = log_source._Options({"path": log.path, "max_events": "5"}, log.events().schema)
    reader = log_source.EventLogStreamReader(options)
    assert [reader.initialOffset()] + [reader.latestOffset() for _ in range(4)] == [{"position": p} for p in (-1, 4, 9, 11, 11)]
    again = log_source.EventLogStreamReader(options)
    again.partitions({"position": 4}, {"position": 9})
    assert again.latestOffset() == {"position": 11}
    with pytest.raises(InvalidValue):
        log_source._Options({"path": log.path, "max_events": "0"}, log.events().schema)
    with pytest.raises(InvalidValue):
        log_source._Options({}, log.events().schema)


def test_stream_is_restarted(spark, tmp_path):
    log, seen = stored(spark, tmp_path), {}

    def started():
        rows = spark.readStream.format("event_log").option("path", log.path).option("max_events", 5).load()
        keep = lambda df, n: seen.__setitem__(n, sorted(r[0] for r in df.select("global_position").collect()))
        return rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/check").start()

    query = started()
    query.processAllAvailable()
    query.stop()
    assert seen == {0: [0, 1, 2, 3, 4], 1: [5, 6, 7, 8, 9], 2: [10, 11]}
    more = Log().node(20, "x").node(20, "y").frame(spark).selectExpr("concat('new', id) AS id", *COLUMNS[1:])
    log.append("t", ExpectedVersion.NO_STREAM, more)
    query = started()
    query.processAllAvailable()
    query.stop()
    assert seen[3] == [12, 13] and len(seen) == 4


def bytes_below(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_store_equals_replay(spark, tmp_path):
    rows = small_log().frame(spark)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=4)
    assert store.position() is None and store.projection().facts.isEmpty()
    for low, high in ((0, 6), (6, 9), (9, 12)):
        assert store.apply(rows.filter(f"global_position >= {low} AND global_position < {high}"), strict=high == 9) == high - 1
    whole = replay.replay(rows, strict=False).projection
    assert store.projection().equals(whole)
    for clock in ((0, 5), (30, 9), (100, 100)):
        ours, theirs = store.view(*clock), whole.view(*clock)
        assert sorted(r["id"] for r in ours.facts.collect()) == sorted(r["id"] for r in theirs.facts.collect())
        assert sorted((r["id"], r["label"]) for r in ours.nodes.collect()) == sorted((r["id"], r["label"]) for r in theirs.nodes.collect())
    # A batch that comes again, alone or with newer events, changes nothing more.
    assert store.apply(rows.filter("global_position > 3")) == 11
    assert store.projection().equals(whole)
    assert {r["stream_id"]: r["stream_version"] for r in store.table("streams").collect() if r["position"] == 11} == {"s": 11}


def test_store_after_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that stops after its facts were written is as if it had not been; merged again it counts once."""
    rows = small_log().frame(spark)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=4)
    store.apply(rows.filter("global_position < 6"), strict=False)
    real = store._overwrite

    def failing(df, name, key):
        if name == "streams":
            raise OSError("lost")
        real(df, name, key)

    monkeypatch.setattr(store, "_overwrite", failing)
    with pytest.raises(OSError):
        store.apply(rows.filter("global_position >= 6"), strict=False)
    assert store.position() == 5 and store.projection().equals(replay.replay(rows.filter("global_position < 6"), strict=False).projection)
    monkeypatch.setattr(store, "_overwrite", real)
    store.apply(rows.filter("global_position >= 6"))
    assert store.projection().equals(replay.replay(rows, strict=False).projection)


def test_store_checks_batches(spark, tmp_path):
    rows = small_log().frame(spark)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=3)
    store.apply(rows.filter("global_position < 4"))
    with pytest.raises(InvalidReplay):
        store.apply(rows.filter("global_position > 5"))
    stranger = Log()
    stranger.rows, stranger.versions = small_log().rows[:4], {"s": 3}
    with pytest.raises(MissingEntity):
        store.apply(stranger.fact(5, "f9", "a", "likes", "nobody").frame(spark))
    assert store.position() == 3
    with pytest.raises(InvalidValue):
        ProjectionStore(spark, "x", 0)


def test_bytes_grow_with_the_batch(spark, tmp_path):
    """A batch on one entity rewrites a bucket of each table, however much the others hold."""
    log = Log()
    for i in range(300):
        log.node(1, f"n{i}")
    for i in range(299):
        log.fact(2, f"f{i}", f"n{i}", "likes", f"n{i + 1}")
    rows = log.frame(spark)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=32)
    store.apply(rows, strict=False)
    whole, before = bytes_below(tmp_path / "state"), {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    log.node(3, "n7", label="again").fact(4, "more", "n7", "likes", "n8", supersedes="f7")
    store.apply(log.frame(spark), strict=False)
    written = sum(p.stat().st_size for p in (tmp_path / "state").rglob("*.parquet") if p not in before)
    assert 0 < written < whole / 5
    assert store.projection().equals(replay.replay(log.frame(spark), strict=False).projection)


def test_batches_write_what_they_bring(spark, tmp_path):
    """Batches that touch all buckets don't rewrite what the store holds."""
    log, store, written = Log(), ProjectionStore(spark, f"file://{tmp_path}/state", buckets=4), []
    for batch in range(6):
        for i in range(400):
            log.node(batch, f"n{batch}-{i}", attributes={"text": f"{i * 7919}"})
        before = set((tmp_path / "state").rglob("*.parquet"))
        store.apply(log.frame(spark).filter(f"global_position >= {400 * batch}"), strict=False)
        written.append(sum(p.stat().st_size for p in set((tmp_path / "state").rglob("*.parquet")) - before))
    assert written[5] < 1.5 * written[1]
    assert store.table("nodes").count() == 2400


def test_pending_batches_are_folded(spark, tmp_path, monkeypatch):
    """A read is the same before a fold, after one and after one that stopped half-way."""
    monkeypatch.setattr(projection_store, "FOLD_FROM", 2)
    rows = small_log().frame(spark)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=4)
    pending, real, fails = [], store._overwrite, []

    def lost(df, name, key):
        real(df, name, key)
        if name in fails:
            raise OSError("lost")

    monkeypatch.setattr(store, "_overwrite", lost)
    for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12)):
        part = rows.filter(f"global_position >= {low} AND global_position < {high}")
        store.apply(part)
        pending.append(store._starts())
        whole = replay.replay(rows.filter(f"global_position < {high}"), strict=False).projection
        assert store.projection().equals(whole)
        ours, theirs = store.view(30, 9), whole.view(30, 9)
        assert sorted(r["id"] for r in ours.facts.collect()) == sorted(r["id"] for r in theirs.facts.collect())
    # The first batch is folded at once, four events then with the next four; two more wait.
    assert pending == [[], [4], [], [8], [8, 10]]
    fails[:] = ["facts"]
    with pytest.raises(OSError):
        store.fold()
    assert store._folded() == 7 and store.projection().equals(whole)
    fails.clear()
    store.fold()
    assert store._starts() == [] and store._folded() == 11 and store.projection().equals(whole)


def test_store_follows_a_stream(spark, tmp_path):
    log = stored(spark, tmp_path)
    store = ProjectionStore(spark, f"file://{tmp_path}/state", buckets=4)
    for _ in range(2):
        query = store.follow(log.path, f"file://{tmp_path}/check", 4, strict=False)
        query.processAllAvailable()
        query.stop()
    assert store.position() == 11 and store.projection().equals(replay.replay(log.events(), strict=False).projection)


def plain_bursts(ats, gap):
    n = longest_gap = run = longest_run = 0
    for i, at in enumerate(ats):
        step = at - ats[i - 1] if i else 0
        run = run + 1 if i and step <= gap else 1
        n, longest_gap, longest_run = n + 1, max(longest_gap, step), max(longest_run, run)
    return (n, longest_gap, longest_run)


def test_fold_is_resumed(spark, tmp_path):
    log, fold = stored(spark, tmp_path), folds.Bursts(1)
    target = f"file://{tmp_path}/shown"
    for expected in (12, 14):
        query = folds.project(spark, fold, log.path, target, f"file://{tmp_path}/check", 5)
        query.processAllAvailable()
        query.stop()
        ats = [r[0] for r in log.load_stream("s").select("recorded_at").collect()]
        rows = {r["stream_id"]: r for r in folds.current(spark, fold, target).collect()}
        assert tuple(rows["s"])[3:] == plain_bursts(ats, 1) and rows["s"]["stream_version"] == len(ats) - 1 == expected - 1
        assert folds.verified(spark, fold, target, spark.createDataFrame([("s", expected - 1)], "stream_id string, stream_version bigint")).isEmpty()
        if expected == 12:
            more = Log().node(20, "x").node(21, "y").frame(spark).selectExpr("concat('new', id) AS id", *COLUMNS[1:])
            log.append("s", ExpectedVersion.ANY, more)
            log.append("t", ExpectedVersion.NO_STREAM, more.selectExpr("concat('other', id) AS id", *COLUMNS[1:]))
    assert tuple(rows["t"])[3:] == (2, 1, 2)


def test_fold_rejects_gaps(spark, tmp_path):
    """A log whose stream lacks a version fails the query instead of being folded."""
    events = small_log().frame(spark).filter("stream_version <> 3")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKSDB)
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    rows = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    query = folds.folded(rows, folds.Bursts(1)).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"file://{tmp_path}/check").start()
    with pytest.raises(StreamingQueryException, match="expected 3"):
        query.processAllAvailable()


def test_fold_of_a_table(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKSDB)
    rows = small_log().frame(spark)
    got = folds.folded(rows, folds.Bursts(1)).collect()
    assert [tuple(r)[3:] for r in got] == [plain_bursts([r["recorded_at"] for r in rows.orderBy("stream_version").collect()], 1)]
