"""A projection that is kept up to date in place: a batch of events is written once, as it comes, and now and then what
came in is merged into tables bucketed by entity and by fact.

pending   events that the tables don't hold yet, a folder for each batch, named by the position at which it starts
nodes     revisions, bucketed by entity
facts     facts with what came after them: the fact that replaces a fact and its last retraction stand on the
          fact's own row, so a read at a clock is a filter and needs no anti-join; bucketed by fact
streams   the last version of each stream
cursor    the global position up to which a read sees everything, written last
folded    the global position up to which nodes and facts hold everything

So what a batch writes grows with the batch, not with the state. A read merges what is pending with the buckets.
Pending events are folded into the buckets that they touch, by Spark's dynamic partition overwrite, once they are as
many as the events folded before: over any number of batches a row is rewritten about as often as the state doubled.

A batch that failed half-way, or is delivered again by a stream, is merged again: its folder is the same and replaced,
what lies beyond the cursor is left out when it is read, and events up to the cursor are skipped. A fold that failed
half-way is left out likewise, as its events are still pending. Checks run against the touched buckets alone.

A bucket that outgrows a task is written as several files by several tasks. The number of buckets is fixed when
the store is made and should fit the state that is expected: a fold rewrites a bucket for each entity and fact
that it touches, at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest import schema
from palimpsest.errors import InvalidValue
from palimpsest.operators import replay
from palimpsest.operators.view import Projection, View, is_current
from palimpsest.streaming import log_source

#: What a fact's row has beside the fact: its replacement, and its last retraction.
LATER = "replacement string, replaced_from bigint, replaced_at bigint, replaced_position bigint, ended_until bigint, ended_at bigint, ended_position bigint"
LATER_NAMES = [c.split(" ")[0] for c in LATER.split(", ")]
TABLES = {
    "nodes": schema.NODE_REVISION,
    "facts": f"{schema.STORED_FACT}, {LATER}",
    "streams": "stream_id string, stream_version bigint, position bigint",
}


#: The first batch, often a load of all there is, is folded at once; later ones from so many on, if they hold as many events as
#: the buckets, and in any case at the second number.
FOLD_FROM, FOLD_AT = 16, 256


class ProjectionStore:
    """The tables below a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        if buckets < 1:
            raise InvalidValue("projection store: buckets must be positive")
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---- reads

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _raw(self, name: str) -> DataFrame:
        ddl = f"{TABLES[name]}, bucket int"
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], ddl)

    def _marked(self, name: str) -> int | None:
        return self.spark.read.schema("position bigint").parquet(f"{self.path}/{name}").agg(F.max("position")).first()[0] if self._exists(name) else None

    def _mark(self, name: str, position: int) -> None:
        self.spark.range(1).select(F.lit(position).cast("long").alias("position")).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def position(self) -> int | None:
        """The last position that a read sees, None for an empty store."""
        return self._marked("cursor")

    def _folded(self) -> int | None:
        """The last position that the buckets hold: of a store that never had pending events, the cursor."""
        return self._marked("folded") if self._exists("folded") or self._exists("pending") else self.position()

    def _starts(self) -> list[int]:
        """The positions at which pending batches start."""
        if not self._exists("pending"):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pending")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(int(s.getPath().getName().removeprefix("since=")) for s in found if s.getPath().getName().startswith("since="))

    def _pending(self, folded: int | None, upto: int | None) -> DataFrame:
        """Events behind the buckets, as of a position."""
        first = 0 if folded is None else folded + 1
        paths = [f"{self.path}/pending/since={s}" for s in self._starts() if first <= s and upto is not None and s <= upto]
        if not paths:
            return self.spark.createDataFrame([], schema.STORED_EVENT)
        return self.spark.read.schema(schema.STORED_EVENT).parquet(*paths).filter(F.col("global_position").between(first, upto))

    def table(self, name: str, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """A table as of the cursor (given, or the store's own), in the given buckets or all."""
        upto = self.position() if upto is None else upto
        folded = upto if name == "streams" else self._folded()
        rows = self._raw(name)
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        rows = rows.filter(F.col("position") <= (-1 if folded is None else folded)).drop("bucket")
        if name == "streams":
            return rows
        near = lambda df, *keys: df if buckets is None else df.filter(functools.reduce(Column.__or__, [F.coalesce(self._bucket(k).isin(buckets), F.lit(False)) for k in keys]))
        nodes, facts, gone = replay._tables(self._pending(folded, upto))
        if name == "nodes":
            return rows.unionByName(near(nodes, "id"))
        blank = {c: F.when(F.col("replaced_position") <= folded, F.col(c)) for c in ("replacement", "replaced_from", "replaced_at", "replaced_position")}
        blank |= {c: F.when(F.col("ended_position") <= folded, F.col(c)) for c in ("ended_until", "ended_at", "ended_position")}
        return near(merge_facts(rows.withColumns(blank), near(facts, "id", "supersedes"), near(gone, "fact_id")), "id")

    def _projection(self, nodes: DataFrame, facts: DataFrame, position: int | None) -> Projection:
        replaced = facts.filter("replacement IS NOT NULL").select(F.col("id").alias("prior"), "replacement", F.col("replaced_from").alias("valid_from"), F.col("replaced_at").alias("recorded_at"))
        ended = facts.filter("ended_position IS NOT NULL").select(F.col("id").alias("fact_id"), F.col("ended_until").alias("valid_until"), F.col("ended_at").alias("recorded_at"))
        return Projection(nodes, facts.drop(*LATER_NAMES), replaced, ended, position)

    def projection(self) -> Projection:
        at = self.position()
        return self._projection(self.table("nodes", upto=at), self.table("facts", upto=at), at)

    def view(self, valid_at: int, known_at: int) -> View:
        """As Projection.view, from the facts' own rows."""
        at = self.position()
        nodes = self._projection(self.table("nodes", upto=at), self.table("facts", upto=at), at).visible_nodes(known_at)
        replaced = (F.col("replaced_at") <= known_at) & (F.col("replaced_from") <= valid_at)
        ended = (F.col("ended_at") <= known_at) & (F.col("ended_until") <= valid_at)
        facts = self.table("facts", upto=at).filter(is_current(valid_at, known_at)).filter(~F.coalesce(replaced, F.lit(False)) & ~F.coalesce(ended, F.lit(False)))
        ids = nodes.select("id")
        for end in ("source", "target"):
            facts = facts.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return View(nodes, facts.drop(*LATER_NAMES))

    # ---- writes

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: list[DataFrame]) -> list[int]:
        """Buckets of keys (tables of one column): `buckets` numbers at most."""
        all_keys = functools.reduce(DataFrame.union, [k.toDF("key") for k in keys])
        return sorted(r[0] for r in all_keys.filter("key IS NOT NULL").select(self._bucket("key").alias("b")).distinct().collect())

    def _overwrite(self, rows: DataFrame, name: str, key: str) -> None:
        rows = rows.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def apply(self, events: DataFrame, strict: bool = True) -> int | None:
        """Merge a batch (schema.STORED_EVENT) and return the new position. strict raises its first error and
        leaves the store as it was."""
        at = self.position()
        if at is not None and not self._exists("pending") and not self._exists("folded"):
            self._mark("folded", at)
        path = f"{self.path}/pending/since={0 if at is None else at + 1}"
        events.filter(F.col("global_position") > (-1 if at is None else at)).write.mode("overwrite").parquet(path)
        batch = self.spark.read.schema(schema.STORED_EVENT).parquet(path)
        last = batch.agg(F.max("global_position")).first()[0]
        if last is None:
            return at
        newest = batch.groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"), F.max("global_position").alias("position"))
        stream_buckets = self._touched([newest.select("stream_id")])
        # A stream keeps the version before as well, for a batch that is merged again: the greatest up to the cursor counts.
        old_streams = self.table("streams", stream_buckets, -1 if at is None else at).groupBy("stream_id").agg(F.max(F.struct("stream_version", "position")).alias("s")).select("stream_id", "s.*")
        if strict:
            self._check(batch, at, old_streams)
        self._overwrite(old_streams.unionByName(newest), "streams", "stream_id")
        self._mark("cursor", last)
        folded, waiting = self._folded(), len(self._starts())
        if folded is None or waiting >= FOLD_AT or waiting >= FOLD_FROM and last - folded >= folded + 1:
            self.fold()
        return last

    def _check(self, batch: DataFrame, at: int | None, old_streams: DataFrame) -> None:
        nodes, facts, gone = replay._tables(batch)
        node_buckets = self._touched([nodes.select("id"), facts.select("source"), facts.select("target")])
        fact_buckets = self._touched([facts.select("id"), facts.select("supersedes"), gone.select("fact_id")])
        before = -1 if at is None else at
        known = self._projection(self.table("nodes", node_buckets, before), self.table("facts", fact_buckets, before), at)
        replay.raise_first(replay.violations(batch, replay.Cursor(at, old_streams.select("stream_id", "stream_version")), known))

    def fold(self) -> None:
        """Merge what is pending into the buckets that it touches. The mark is written last, then what was pending goes."""
        at, folded = self.position(), self._folded()
        if at is None or at == folded:
            return
        nodes, facts, gone = replay._tables(self._pending(folded, at))
        node_buckets = self._touched([nodes.select("id")])
        fact_buckets = self._touched([facts.select("id"), facts.select("supersedes"), gone.select("fact_id")])
        if fact_buckets:
            self._overwrite(self.table("facts", fact_buckets, at), "facts", "id")
        if node_buckets:
            self._overwrite(self.table("nodes", node_buckets, at), "nodes", "id")
        self._mark("folded", at)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for start in self._starts():
            if start <= at:
                old = path(f"{self.path}/pending/since={start}")
                old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def follow(self, log_path: str, checkpoint: str, max_events: int, strict: bool = True) -> StreamingQuery:
        """A running query that applies the log in micro-batches of max_events, and goes on where it stopped."""
        log_source.register(self.spark)
        rows = self.spark.readStream.format(log_source.FORMAT).option("path", log_path).option("max_events", max_events).load()
        return rows.writeStream.foreachBatch(lambda batch, _: self.apply(batch, strict)).option("checkpointLocation", checkpoint).start()


def merge_facts(old: DataFrame, facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts with what came after them: old rows (TABLES["facts"]) and the batch's facts and retractions, of which
    the last of a fact counts."""
    none = [F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in LATER.split(", ")]
    rows = old.unionByName(facts.select("*", *none))
    replaced = facts.filter("supersedes IS NOT NULL").select(
        F.col("supersedes").alias("id"), F.struct(F.col("id").alias("replacement"), F.col("valid_from").alias("replaced_from"), F.col("recorded_at").alias("replaced_at"), F.col("position").alias("replaced_position")).alias("_r")
    )
    replaced = replaced.groupBy("id").agg(F.max_by("_r", F.col("_r.replaced_position")).alias("_r"))
    ended = gone.groupBy(F.col("fact_id").alias("id")).agg(
        F.max_by(F.struct(F.col("valid_until").alias("ended_until"), F.col("recorded_at").alias("ended_at"), F.col("position").alias("ended_position")), "position").alias("_e")
    )
    rows = rows.join(replaced, "id", "left").join(ended, "id", "left")
    pick = lambda new, name: F.when(F.col(new).isNotNull(), F.col(f"{new}.{name}")).otherwise(F.col(name))
    later = {c: pick("_e" if c.startswith("ended") else "_r", c) for c in LATER_NAMES}
    return rows.withColumns(later).drop("_r", "_e")
