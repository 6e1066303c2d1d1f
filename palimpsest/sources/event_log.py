"""The event log: immutable Parquet batches, each made visible by one manifest.

A batch is written under a temporary name, then renamed; it counts once its manifest
`manifests/NNN.json` exists. The manifest is renamed into place only if absent, so it is whole when it is
seen, and of two writers with the same expectation one wins (optimistic concurrency); a batch without
manifest is a partial tail. Every `CHECKPOINT_EVERY` manifests one file repeats all of them, so that a
reader opens that file and the few manifests behind it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from enum import Enum
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.errors import Corruption, DuplicateEvent, ExternalModification, InvalidValue, VersionConflict
from palimpsest.functions.text import is_bad_text
from palimpsest.sources.storage import TASK_ROWS, content_digest, in_ranges, materialize, write_digested

CHECKPOINT_EVERY = 32
#: Row groups of a batch are small, so that a range of positions is read by the groups that hold it.
BLOCK_BYTES = 8 << 20


class ExpectedVersion:
    """ANY, NO_STREAM or the exact last version (an int)."""

    ANY = "any"
    NO_STREAM = "no_stream"


class RecoveryPolicy(Enum):
    STRICT = "strict"
    TRUNCATE_PARTIAL_TAIL = "truncate_partial_tail"


@dataclass(frozen=True)
class AppendReceipt:
    event_count: int = 0
    first_stream_version: int | None = None
    last_stream_version: int | None = None
    first_global_position: int | None = None
    last_global_position: int | None = None


@dataclass(frozen=True)
class LogOptions:
    recovery: RecoveryPolicy = RecoveryPolicy.STRICT
    max_batch_rows: int = 1 << 33

    def __post_init__(self) -> None:
        if self.max_batch_rows < 1:
            raise InvalidValue("max_batch_rows must be positive")


class EventLog:
    """Append-only store of schema.STORED_EVENT rows in a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, options: LogOptions):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def open(spark: SparkSession, path: str, options: LogOptions = LogOptions()) -> EventLog:
        log = EventLog(spark, path, options)
        log._fs.mkdirs(log._fs_path(f"{log.path}/manifests"))
        log._fs.mkdirs(log._fs_path(f"{log.path}/batches"))
        log._fs.mkdirs(log._fs_path(f"{log.path}/checkpoints"))
        log._recover()
        return log

    # ---- files

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._fs_path(f"{self.path}/{folder}")))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._fs_path(f"{self.path}/{path}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as error:
            if "ChecksumException" not in str(error.java_exception):
                raise
            raise Corruption(f"{path} does not match its checksum") from error
        finally:
            stream.close()

    def _parsed(self, path: str) -> dict | list:
        try:
            return json.loads(self._read(path))
        except ValueError as error:
            raise Corruption(f"{path} is damaged") from error

    def _place(self, path: str, text: str) -> None:
        """The file appears whole, or not at all where there is one already."""
        draft = self._fs_path(f"{self.path}/_tmp-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._fs_path(f"{self.path}/{path}"), none)
        except Exception:
            self._fs.delete(draft, False)
            raise

    def _manifests(self) -> list[dict]:
        names, known = self._names("manifests"), []
        if checkpoints := self._names("checkpoints"):
            known = self._parsed(f"checkpoints/{checkpoints[-1]}")
        found = known + [self._parsed(f"manifests/{name}") for name in names[len(known) :]]
        if [m["number"] for m in found] != list(range(len(names))) or [f"{m['number']:08d}.json" for m in found] != names:
            raise Corruption("manifests are not contiguous")
        return found

    def _recover(self) -> None:
        """Batches without a manifest: an error when strict, else removed. Batches that a manifest
        names and that are missing, or hold another number of rows, are never repaired."""
        named = {m["batch"] for m in self._manifests()}
        there = set(self._names("batches"))
        if named - there:
            raise Corruption(f"missing batches: {sorted(named - there)[:3]}")
        for extra in sorted(there - named):
            if self.options.recovery is RecoveryPolicy.STRICT:
                raise Corruption(f"batch {extra} has no manifest")
            self._fs.delete(self._fs_path(f"{self.path}/batches/{extra}"), True)

    def verify(self) -> None:
        """Every batch holds the rows that its manifest was made for, by number and content."""
        for m in self._manifests():
            if content_digest(self._batches([m])) != m["digest"]:
                raise Corruption(f"batch {m['batch']} does not hold what its manifest says")

    # ---- reads

    def _batches(self, manifests: list[dict]) -> DataFrame:
        paths = [f"{self.path}/batches/{m['batch']}" for m in manifests]
        if not paths:
            return self.spark.createDataFrame([], schema.STORED_EVENT)
        return self.spark.read.schema(schema.STORED_EVENT).parquet(*paths)

    def events(self) -> DataFrame:
        return self._batches(self._manifests())

    def batch_rows(self, first: int, last: int) -> DataFrame:
        """The committed batches numbered first to last."""
        return self._batches([m for m in self._manifests() if first <= m["number"] <= last])

    def load_stream(self, stream: str, after: int | None = None) -> DataFrame:
        """Events of one stream behind version `after`, in version order. Manifests name the batches that hold them."""
        own = [m for m in self._manifests() if m["stream"] == stream and (after is None or m["last_stream_version"] > after)]
        rows = self._batches(own)
        return (rows if after is None else rows.filter(F.col("stream_version") > after)).orderBy("stream_version")

    def load_all(self, after: int | None = None, limit: int | None = None) -> DataFrame:
        """Events behind position `after`, at most limit, in order. Positions have no gaps, so a limit is a range of
        them: it is filtered and not counted, and only batches that reach into it are read."""
        first = 0 if after is None else after + 1
        last = None if limit is None else first + limit - 1
        near = [m for m in self._manifests() if m["last_global_position"] >= first and (last is None or m["last_global_position"] - m["rows"] < last)]
        rows = self._batches(near).filter(F.col("global_position") >= first)
        return (rows if last is None else rows.filter(F.col("global_position") <= last)).orderBy("global_position")

    def last_position(self) -> int | None:
        manifests = self._manifests()
        return manifests[-1]["last_global_position"] if manifests else None

    def stream_version(self, stream: str) -> int | None:
        versions = [m["last_stream_version"] for m in self._manifests() if m["stream"] == stream and m["rows"]]
        return max(versions, default=None)

    def count(self) -> int:
        return sum(m["rows"] for m in self._manifests())

    def is_empty(self) -> bool:
        return self.count() == 0

    # ---- append

    def _repeated_id(self, rows: DataFrame, n: int, near: list[dict]) -> str | None:
        """An id that the n rows hold twice, or that they share with the batches near. Only their ids are read, and meet as
        64-bit hashes; the ids themselves are compared where two hashes are equal."""
        hashed = lambda df, own: df.select(F.xxhash64("id").alias("h"), F.lit(own).alias("own"))
        both = hashed(rows, True).unionByName(hashed(self._batches(near), False)) if near else hashed(rows, True)
        tasks = -(-(n + sum(m["rows"] for m in near)) // TASK_ROWS)
        met = both.repartition(tasks, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own")).filter("n > 1 AND own > 0")
        if met.agg(F.min("h")).first()[0] is None:
            return None
        twice = rows.groupBy("id").count().filter("count > 1").select("id").limit(1).collect()
        known = self._batches(near).select("id").join(rows.select("id"), "id", "left_semi").limit(1).collect() if near else []
        return (twice or known)[0]["id"] if twice or known else None

    def append(self, stream: str, expected: str | int, events: DataFrame, order: tuple[str, ...] = ("recorded_at", "id")) -> AppendReceipt:
        """Append a batch (schema.EVENT) to one stream, all of it or nothing. The order columns give
        the batch's order. An empty batch checks the version and creates nothing."""
        if not stream or stream != stream.strip():
            raise InvalidValue("stream id must be non-empty without outer white space")
        manifests = self._manifests()
        last = max((m["last_stream_version"] for m in manifests if m["stream"] == stream and m["rows"]), default=None)
        if expected == ExpectedVersion.NO_STREAM and last is not None:
            raise VersionConflict(stream, None, last)
        if isinstance(expected, int) and last != expected:
            raise VersionConflict(stream, expected, last)
        # Written once, in order: what is checked is what is stored, whatever the plan of events reads.
        names = [c.strip().split(" ")[0] for c in _columns(schema.EVENT)]
        held = materialize(in_ranges(events.select(*names), list(order)), "append-draft")
        bad = is_bad_text(F.col("id")) | is_bad_text(F.col("event_type")) | (F.col("occurred_at") > F.col("recorded_at"))
        spans = [F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.when(bad, F.struct("id"))).alias("bad")]
        # One row for each range of TASK_ROWS rows.
        parts = sorted(held.groupBy("_part").agg(*spans).collect())
        n = sum(p["n"] for p in parts)
        if not n:
            return AppendReceipt()
        if n > self.options.max_batch_rows:
            raise InvalidValue(f"a batch of {n} rows is larger than max_batch_rows")
        wrong = [p["bad"]["id"] for p in parts if p["bad"] is not None]
        if wrong:
            raise InvalidValue(f"event {wrong[0]}: text or times")
        low, high = min(p["low"] for p in parts), max(p["high"] for p in parts)
        repeated = self._repeated_id(held, n, [m for m in manifests if m["first_id"] <= high and m["last_id"] >= low])
        if repeated is not None:
            raise DuplicateEvent(repeated)
        base, version = sum(m["rows"] for m in manifests), -1 if last is None else last
        sizes = {p["_part"]: p["n"] for p in parts}
        before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes)))]
        at = F.get(F.lit(before), F.col("_part")) + F.col("_row")
        rows = held.withColumns({"stream_id": F.lit(stream), "stream_version": at + (version + 1), "global_position": at + base})
        rows = rows.select(*names, "stream_id", "stream_version", "global_position")
        number = len(manifests)
        batch = f"{number:08d}-{uuid.uuid4().hex}"
        digest = write_digested(rows, f"{self.path}/_tmp-{batch}", BLOCK_BYTES)
        if not self._fs.rename(self._fs_path(f"{self.path}/_tmp-{batch}"), self._fs_path(f"{self.path}/batches/{batch}")):
            self._fs.delete(self._fs_path(f"{self.path}/_tmp-{batch}"), True)
            raise ExternalModification(f"batch {batch} could not be put in place")
        manifest = {
            "number": number, "stream": stream, "batch": batch, "rows": n, "last_stream_version": version + n, "last_global_position": base + n - 1,
            "first_id": low, "last_id": high, "digest": digest if _stored_as(rows) else content_digest(self._batches([{"batch": batch}])),
        }
        try:
            self._place(f"manifests/{number:08d}.json", json.dumps(manifest))
        except Exception as error:
            self._fs.delete(self._fs_path(f"{self.path}/batches/{batch}"), True)
            raise ExternalModification("another writer appended first") from error
        if number % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            self._place(f"checkpoints/{number:08d}.json", json.dumps([*manifests, manifest]))
        return AppendReceipt(n, version + 1, version + n, base, base + n - 1)


def _stored_as(rows: DataFrame) -> bool:
    """Rows of just the types in which a batch is read again; others (an int for a bigint, other fields of a struct) may read differently."""
    return rows.dtypes == rows.sparkSession.createDataFrame([], schema.STORED_EVENT).dtypes


def _columns(ddl: str) -> list[str]:
    out, depth = [], 0
    for piece in ddl.split(","):
        if depth:
            out[-1] += "," + piece
        else:
            out.append(piece)
        depth += piece.count("<") - piece.count(">")
    return out


def position_problems(rows: DataFrame) -> DataFrame:
    """What a restored log breaks: (error, detail), from aggregates alone."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min("global_position").alias("a"), F.max("global_position").alias("b"), F.countDistinct("global_position").alias("d"))
    gaps = total.filter("n > 0 AND (a <> 0 OR b <> n - 1 OR d <> n)").select(F.lit("InvalidReplay").alias("error"), F.lit("global positions").alias("detail"))
    streams = rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("stream_version").alias("a"), F.max("stream_version").alias("b"))
    wrong = streams.filter("a <> 0 OR b <> n - 1").select(F.lit("InvalidReplay").alias("error"), F.col("stream_id").alias("detail"))
    ids = rows.groupBy("id").count().filter("count > 1").select(F.lit("DuplicateEvent").alias("error"), F.col("id").alias("detail"))
    return gaps.union(wrong).union(ids)
