import json

import pytest
from builders import Log, ids, node
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.errors import Corruption, DuplicateEvent, InvalidValue, VersionConflict
from palimpsest.operators import replay
from palimpsest.sources import codec, event_log
from palimpsest.sources.event_log import EventLog, ExpectedVersion, LogOptions, RecoveryPolicy, position_problems
from palimpsest.sources.snapshot import SnapshotStore
from palimpsest.sources.storage import content_digest
from palimpsest.streaming.subscription import WRITE_EVERY, CatchUpSubscription, IncrementalProjection, for_each_batch


def batch(spark, *names):
    rows = [(n, "node_upserted", i + 1, i + 1, "a", "s", None, None, ("node_upserted", node(n), None, None, None, None)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, schema.EVENT)


def test_append_and_read(spark, tmp_path):
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    receipt = log.append("s1", ExpectedVersion.NO_STREAM, batch(spark, "a", "b"))
    assert (receipt.event_count, receipt.first_stream_version, receipt.last_global_position) == (2, 0, 1)
    assert log.append("s2", ExpectedVersion.ANY, batch(spark, "c")).first_global_position == 2
    assert log.append("s1", 1, batch(spark, "d")).last_stream_version == 2
    with pytest.raises(VersionConflict):
        log.append("s1", 0, batch(spark, "e"))
    with pytest.raises(DuplicateEvent):
        log.append("s1", ExpectedVersion.ANY, batch(spark, "a"))
    with pytest.raises(DuplicateEvent):
        log.append("s1", ExpectedVersion.ANY, batch(spark, "x", "x"))
    assert log.append("s9", ExpectedVersion.NO_STREAM, batch(spark).limit(0)).event_count == 0
    assert log.stream_version("s9") is None and log.count() == 4
    assert [r["id"] for r in log.load_stream("s1", 0).collect()] == ["b", "d"]
    assert [r["id"] for r in log.load_all(0, 2).collect()] == ["b", "c"]
    assert position_problems(log.events()).isEmpty()
    assert ids(replay.replay(log.events()).projection.view(9, 9).nodes) == ["a", "b", "c", "d"]


def test_recovery(spark, tmp_path):
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.ANY, batch(spark, "a"))
    batch(spark, "z").write.parquet(f"file://{tmp_path}/log/batches/00000001-partial")
    with pytest.raises(Corruption):
        EventLog.open(spark, f"file://{tmp_path}/log")
    again = EventLog.open(spark, f"file://{tmp_path}/log", LogOptions(RecoveryPolicy.TRUNCATE_PARTIAL_TAIL))
    assert again.count() == 1
    again.verify()
    (tmp_path / "log/manifests/00000000.json").write_text(json.dumps({"number": 0, "stream": "s", "batch": "gone", "rows": 1, "last_stream_version": 0, "last_global_position": 0}))
    for reason in ("checksum", "missing batches"):
        with pytest.raises(Corruption, match=reason):
            EventLog.open(spark, f"file://{tmp_path}/log", LogOptions(RecoveryPolicy.TRUNCATE_PARTIAL_TAIL))
        (tmp_path / "log/manifests/.00000000.json.crc").unlink(missing_ok=True)


def test_damage_and_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log, "CHECKPOINT_EVERY", 2)
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    for name in "abc":
        log.append("s", ExpectedVersion.ANY, batch(spark, name))
    assert [p.name for p in sorted((tmp_path / "log/checkpoints").glob("*.json"))] == ["00000001.json"]
    again = EventLog.open(spark, log.path)
    assert again.count() == 3 and again.stream_version("s") == 2
    again.verify()
    with pytest.raises(DuplicateEvent):
        again.append("s", 2, batch(spark, "b"))
    # As many rows as before, but others.
    first = next((tmp_path / "log/batches").glob("00000000-*"))
    again.events().filter("id = 'c'").coalesce(1).write.parquet(f"file://{tmp_path}/other")
    for old in (*first.glob("*.parquet"), *first.glob(".*.crc")):
        old.unlink()
    next((tmp_path / "other").glob("*.parquet")).rename(first / "part.parquet")
    with pytest.raises(Corruption):
        again.verify()
    with pytest.raises(Exception):
        again._place("manifests/00000000.json", "{}")
    assert json.loads((tmp_path / "log/manifests/00000000.json").read_text())["number"] == 0


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from palimpsest.sources.storage import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(InvalidValue):
        shared_dir(session)


def test_subscription(spark, tmp_path):
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.ANY, batch(spark, *"abcde"))
    sub = CatchUpSubscription(None, 2)
    first = [r["id"] for r in sub.poll(log).collect()]
    assert first == [r["id"] for r in sub.poll(log).collect()] == ["a", "b"]
    with pytest.raises(InvalidValue):
        sub.acknowledge(9)
    sub.acknowledge(0)
    assert [r["id"] for r in sub.poll(log).collect()] == ["b", "c"]
    sub.acknowledge(2)
    assert [r["id"] for r in sub.poll(log).collect()] == ["d", "e"]
    sub.acknowledge(4)
    assert sub.poll(log).count() == 0
    with pytest.raises(InvalidValue):
        sub.acknowledge(4)


def test_stream_and_increments(spark, tmp_path):
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.ANY, batch(spark, "a", "b"))
    log.append("s", ExpectedVersion.ANY, batch(spark, "c"))
    seen = []
    # A batch that was never committed isn't delivered.
    log.events().limit(1).write.parquet(f"file://{tmp_path}/log/batches/00000002-lost")
    for _ in range(2):
        for_each_batch(log, f"file://{tmp_path}/check", lambda df, _: seen.extend(r["id"] for r in df.select("id").collect())).awaitTermination(60)
    assert sorted(seen) == ["a", "b", "c"]
    state = IncrementalProjection(applied=WRITE_EVERY - 1)
    state.apply(log.events().filter("global_position < 2"))
    done = state.apply(log.events().filter("global_position >= 2"))
    assert done.projection.equals(replay.replay(log.events()).projection)


def test_snapshots(spark, tmp_path):
    log = Log().node(1, "a", attributes={"k": "v"}).node(1, "b").fact(2, "f", "a", "r", "b")
    done = replay.replay(log.frame(spark))
    store = SnapshotStore(spark, f"file://{tmp_path}/snapshots")
    assert store.load_latest() is None
    state = replay.Snapshot(done.cursor, done.projection)
    store.save(state)
    store.save(state)
    loaded = store.load_latest()
    assert loaded.cursor.global_position == 2 and loaded.projection.equals(done.projection)
    other = replay.replay(Log().node(1, "a").node(1, "b").fact(2, "g", "a", "r", "b").frame(spark))
    with pytest.raises(Corruption):
        store.save(replay.Snapshot(other.cursor, other.projection))
    damaged = next(p for p in (tmp_path / "snapshots").glob("memory-*/facts/*.parquet"))
    spark.read.parquet(f"file://{damaged.parent}").withColumn("confidence", F.lit(1)).coalesce(1).write.parquet(f"file://{tmp_path}/bad")
    damaged.write_bytes(next((tmp_path / "bad").glob("*.parquet")).read_bytes())
    for crc in damaged.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Corruption):
        store.load_latest()


def test_codecs(spark):
    rows = spark.createDataFrame([("x" * 500, 1), ("y", 2)], "t string, n int").select(F.struct("t", "n").alias("v"))
    json_codec = codec.JsonCodec("t string, n int")
    packed = codec.Lz4Codec(json_codec, 10_000)
    sealed = codec.EncryptedCodec(packed, codec.StaticKey("key-1", b"k" * 32), b"context", 10_000)
    for one in (json_codec, packed, sealed):
        data = rows.select(one.encode(F.col("v")).alias("d"), "v").cache()
        assert all(r["b"] == r["v"] for r in data.select(one.decode(F.col("d")).alias("b"), "v").collect())
    data = rows.select(sealed.encode(F.col("v")).alias("d"))
    wrong = [codec.EncryptedCodec(packed, codec.StaticKey("key-1", b"w" * 32), b"context", 10_000), codec.EncryptedCodec(packed, codec.StaticKey("key-1", b"k" * 32), b"other", 10_000), codec.EncryptedCodec(packed, codec.StaticKey("key-2", b"k" * 32), b"context", 10_000)]
    for one in wrong:
        with pytest.raises(Exception):
            data.select(one.decode(F.col("d"))).collect()
    ring = codec.KeyRing((codec.StaticKey("key-1", b"k" * 32), codec.StaticKey("key-2", b"n" * 16)), "key-2")
    newer = codec.EncryptedCodec(packed, ring, b"context", 10_000)
    both = data.unionByName(rows.select(newer.encode(F.col("v")).alias("d")))
    assert sorted(r["b"]["n"] for r in both.select(newer.decode(F.col("d")).alias("b")).collect()) == [1, 1, 2, 2]
    assert len({bytes(r["d"])[6:18] for r in rows.select(newer.encode(F.col("v")).alias("d")).collect()}) == 2
    with pytest.raises(InvalidValue):
        codec.KeyRing((codec.StaticKey("key-1", b"k" * 32),), "key-2")
    small = codec.Lz4Codec(json_codec, 10)
    with pytest.raises(Exception):
        rows.select(small.encode(F.col("v"))).collect()
    with pytest.raises(InvalidValue):
        codec.StaticKey("", b"k" * 32)


def plain_events(spark, name, n):
    at = F.col("id").cast("long")
    none = F.lit(None).cast("string")
    names = [F.format_string(f"{name}%05d", "id").alias("id"), F.lit("seen").alias("event_type"), at.alias("occurred_at"), at.alias("recorded_at"), F.lit("a").alias("agent_id"), F.lit("s").alias("session_id")]
    return spark.range(n).select(*names, none.alias("correlation_id"), none.alias("causation_id"), F.lit(None).cast(schema.PAYLOAD).alias("payload"))


def test_append_makes_few_passes(spark, tmp_path):
    """A batch is written in order, checked in two passes and stored in one, whatever the log holds."""
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.NO_STREAM, plain_events(spark, "a", 500))
    spark.sparkContext.setJobGroup("append", "one append")
    try:
        log.append("t", ExpectedVersion.NO_STREAM, plain_events(spark, "a001x", 500))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("append")) <= 14
    log.verify()
    rows = log.load_all(499).collect()
    assert [(r["id"], r["stream_version"], r["global_position"]) for r in rows] == [(f"a001x{i:05d}", i, 500 + i) for i in range(500)]


def test_ids_are_compared_where_hashes_are_equal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.NO_STREAM, plain_events(spark, "a", 20))
    log.append("s", 19, plain_events(spark, "b", 20))
    for events in (plain_events(spark, "b", 21), plain_events(spark, "c", 3).unionByName(plain_events(spark, "c", 1))):
        with pytest.raises(DuplicateEvent):
            log.append("s", 39, events)
    assert log.count() == 40


def test_digest_is_of_what_is_read_again(spark, tmp_path):
    """Also where the events come with other types than the log's."""
    log = EventLog.open(spark, f"file://{tmp_path}/log")
    log.append("s", ExpectedVersion.NO_STREAM, plain_events(spark, "a", 20))
    log.append("s", 19, plain_events(spark, "b", 20).withColumn("recorded_at", F.col("recorded_at").cast("int")))
    log.verify()
    assert [m["digest"] for m in log._manifests()] == [content_digest(log.batch_rows(n, n)) for n in (0, 1)]
