"""Projections of one's own: a fold over each stream of the event log, kept by Structured Streaming.

A fold says what its state is, how one event changes it and what it shows. Spark keeps a state and a cursor for
each stream in its state store (RocksDB, with the query's checkpoint), so a restarted query goes on from where
it stopped. The rules of a replay hold: a stream's versions must follow each other without a gap, an event id is
applied once within a micro-batch, and an event at or before the cursor is not applied again.

    class Total(Fold):
        state = "n bigint, amount bigint"
        shows = "n bigint, amount bigint"
        def start(self): return (0, 0)
        def apply(self, state, event): return (state[0] + 1, state[1] + event["recorded_at"])
        def show(self, state): return [state]

    project(spark, Total(), log.path, target, checkpoint, max_events=100_000)

Streams are dealt over tasks by their id. What a task holds of one is its state and the events of one micro-batch,
which `max_events` bounds. The rows that a stream shows after a micro-batch replace the ones before.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.errors import DuplicateEvent, InvalidReplay
from palimpsest.streaming import log_source

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the rows of every projection begin with.
CURSOR = "stream_id string, stream_version bigint, global_position bigint"


class Fold(ABC):
    """state, shows: column lists of the state and of the rows it is shown as. columns: what apply() reads of an
    event beside its cursor."""

    state: str
    shows: str
    columns: Sequence[str] = ("id", "event_type", "occurred_at", "recorded_at", "agent_id")

    @abstractmethod
    def start(self) -> tuple:
        """The state of a stream without events."""

    @abstractmethod
    def apply(self, state: tuple, event: Mapping[str, Any]) -> tuple:
        """The state after an event. An error fails the query, and the micro-batch with it."""

    def apply_all(self, state: tuple, events: pd.DataFrame) -> tuple:
        """The state after sound events in version order. One by one; a fold that can take them at once may do so."""
        for event in events.to_dict("records"):
            state = self.apply(state, event)
        return state

    @abstractmethod
    def show(self, state: tuple) -> list[tuple]:
        """The rows that a state is seen as."""


class Bursts(Fold):
    """How a stream's events cluster in time: their number, the longest gap between one and the next, and the most
    events in a row without a gap of more than `gap` microseconds."""

    state = "n bigint, last_at bigint, longest_gap bigint, run bigint, longest_run bigint"
    shows = "n bigint, longest_gap bigint, longest_run bigint"
    columns = ("recorded_at",)

    def __init__(self, gap: int):
        self.gap = gap

    def start(self) -> tuple:
        return (0, 0, 0, 0, 0)

    def apply(self, state: tuple, event: Mapping[str, Any]) -> tuple:
        n, last_at, longest_gap, run, longest_run = state
        at = event["recorded_at"]
        step = at - last_at if n else 0
        run = run + 1 if n and step <= self.gap else 1
        return (n + 1, at, max(longest_gap, step), run, max(longest_run, run))

    def show(self, state: tuple) -> list[tuple]:
        return [(state[0], state[2], state[4])]


def _width(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


class StreamFold(StatefulProcessor):
    """Keeps (stream_version, global_position) and the fold's state for each stream."""

    def __init__(self, fold: Fold):
        self.fold, self.names = fold, _width(f"{CURSOR}, {fold.shows}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "stream_version bigint, global_position bigint")
        self.value = handle.getValueState("state", self.fold.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        before = int(self.cursor.get()[0]) if self.cursor.exists() else -1
        state = tuple(self.value.get()) if self.value.exists() else self.fold.start()
        events = pd.concat(list(rows), ignore_index=True)
        events = events[events["stream_version"] > before].sort_values("stream_version", kind="stable", ignore_index=True)
        if events.empty:
            return
        twice = events["id"][events["id"].duplicated()]
        if len(twice):
            raise DuplicateEvent(twice.iloc[0])
        wrong = events["stream_version"].to_numpy() != np.arange(before + 1, before + 1 + len(events))
        if wrong.any():
            at = int(wrong.argmax())
            raise InvalidReplay(f"stream {key[0]} version {events['stream_version'].iloc[at]}, expected {before + 1 + at}")
        state = self.fold.apply_all(state, events)
        version, position = int(events["stream_version"].iloc[-1]), int(events["global_position"].iloc[-1])
        self.cursor.update((version, position))
        self.value.update(state)
        shown = [(key[0], version, position, *row) for row in self.fold.show(state)]
        yield pd.DataFrame(shown, columns=self.names)

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold) -> DataFrame:
    """The rows that each touched stream shows after each micro-batch (or, of a table, after all its events).
    events: rows of schema.STORED_EVENT."""
    wanted = list(dict.fromkeys(["stream_id", "stream_version", "global_position", "id", *fold.columns]))
    keyed = events.select(*wanted).groupBy("stream_id")
    return keyed.transformWithStateInPandas(StreamFold(fold), outputStructType=f"{CURSOR}, {fold.shows}", outputMode="Update", timeMode="None")


def project(spark: SparkSession, fold: Fold, log_path: str, target: str, checkpoint: str, max_events: int) -> StreamingQuery:
    """A running query that folds the log and writes what its streams show below target, a folder for each
    micro-batch (written again if the batch is)."""
    log_source.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = spark.readStream.format(log_source.FORMAT).option("path", log_path).option("max_events", max_events).load()

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return folded(events, fold).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, fold: Fold, target: str) -> DataFrame:
    """What every stream shows now: the rows of its last micro-batch."""
    rows = spark.read.schema(f"{CURSOR}, {fold.shows}, batch bigint").parquet(target)
    last = rows.groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"))
    return rows.join(last, ["stream_id", "stream_version"], "left_semi").drop("batch")


def verified(spark: SparkSession, fold: Fold, target: str, log_streams: DataFrame) -> DataFrame:
    """(stream_id, stream_version, projected): streams of the log (stream_id, stream_version) that the projection
    doesn't stand at the end of."""
    at = current(spark, fold, target).groupBy("stream_id").agg(F.max("stream_version").alias("projected"))
    return log_streams.join(at, "stream_id", "left").filter(F.coalesce("projected", F.lit(-1)) != F.col("stream_version"))
