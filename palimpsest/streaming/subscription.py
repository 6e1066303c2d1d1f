"""Catch-up subscriptions and incremental projection over the event log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.errors import InvalidValue
from palimpsest.operators.replay import Cursor, Replay, Snapshot, resume
from palimpsest.operators.view import Projection
from palimpsest.sources.event_log import EventLog
from palimpsest.sources.storage import materialize


@dataclass
class CatchUpSubscription:
    """Pull consumer in global order. poll() doesn't move the checkpoint; acknowledge() does, to any
    delivered position, so what was not acknowledged comes again."""

    checkpoint: int | None
    batch_size: int
    delivered: int | None = None

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise InvalidValue("subscription.batch_size must be positive")

    def poll(self, log: EventLog) -> DataFrame:
        """The next batch_size events at most, a lazy table; where they end is known from the log's manifests."""
        first = 0 if self.checkpoint is None else self.checkpoint + 1
        last = log.last_position()
        self.delivered = None if last is None or last < first else min(last, first + self.batch_size - 1)
        return log.load_all(self.checkpoint, self.batch_size)

    def acknowledge(self, position: int) -> None:
        if self.delivered is None:
            raise InvalidValue("nothing was delivered")
        if position > self.delivered or (self.checkpoint is not None and position < self.checkpoint):
            raise InvalidValue("position was not delivered")
        self.checkpoint, self.delivered = position, None


def manifest_stream(spark: SparkSession, log: EventLog, max_files: int = 100) -> DataFrame:
    """The log's manifests as a stream (number): a batch is in it once it is committed, never before."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(f"{log.path}/manifests")
    return lines.select(F.get_json_object("value", "$.number").cast("long").alias("number"))


def for_each_batch(log: EventLog, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """handle(events, micro-batch) for the committed batches, in Structured Streaming. At least once: a
    micro-batch is marked done after handle() returns."""

    def resolve(manifests: DataFrame, number: int) -> None:
        span = manifests.agg(F.min("number"), F.max("number")).first()
        if span[0] is not None:
            handle(log.batch_rows(span[0], span[1]), number)

    writer = manifest_stream(log.spark, log).writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: After so many batches the state is written, so that plans don't grow with the number of batches.
WRITE_EVERY = 8


@dataclass
class IncrementalProjection:
    """Keeps a projection up to date: each batch is validated against the cursor and added."""

    state: Snapshot | None = None
    applied: int = 0

    def apply(self, events: DataFrame, strict: bool = True) -> Replay:
        done = resume(self.state, events, strict)
        self.state, self.applied = Snapshot(done.cursor, done.projection), self.applied + 1
        if self.applied % WRITE_EVERY == 0:
            p = done.projection
            kept = [materialize(df, "incremental-state") for df in (p.node_revisions, p.facts, p.supersessions, p.retractions)]
            streams = materialize(done.cursor.stream_versions, "incremental-cursor")
            self.state = Snapshot(Cursor(done.cursor.global_position, streams), Projection(*kept, p.last_position))
        return done
