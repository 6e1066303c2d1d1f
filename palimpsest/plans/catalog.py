"""Registered queries of the evidence-memory operators and their SQL twins.

Each query is a thin use of the operators on tables derived from the test data; each twin says the
same in DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.errors import MemoryError_
from palimpsest.functions.text import crc32c, fact_tokens, normalized, stable_hash
from palimpsest.functions.text import node_tokens as node_tokens_of
from palimpsest.operators import analytics, context, evaluation, graph, linking, replay, retrieval, table_functions
from palimpsest.operators.lexical_index import IndexedProvider, LexicalIndex
from palimpsest.operators.table_functions import ExtractionRules
from palimpsest.operators.view import Clock, Projection, bitemporal_matrix, visible_as_of
from palimpsest.plans import memory_sql as sql
from palimpsest.sources import codec, derived, event_log, json_arrays
from palimpsest.sources.clustered import ClusteredProjection
from palimpsest.sources.derived import T96, T97, T98, table
from palimpsest.sources.snapshot import SnapshotStore
from palimpsest.sources.storage import materialize, shared_dir, ship, tasks_for, with_positions
from palimpsest.streaming import folds, log_source
from palimpsest.streaming.projection_store import ProjectionStore
from palimpsest.streaming.subscription import CatchUpSubscription, IncrementalProjection, for_each_batch

Query = Callable[[SparkSession, str], DataFrame]
CLOCK = Clock(T98, T98)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(oracle: str | None = None):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def memory(spark: SparkSession, sf_dir: str) -> Projection:
    """The derived projection, straight from its tables (positions by time and revision). The facts, which all its
    tables but the nodes are made from, are written once."""
    facts = materialize(derived.facts(spark, sf_dir).withColumn("position", F.lit(0).cast("long")), "memory-facts")
    revision = F.when(F.col("label").endswith(" v2"), 1).otherwise(0).cast("long")
    nodes = derived.node_events(spark, sf_dir).withColumn("position", revision)
    gone = derived.retractions_of(facts).withColumnRenamed("ord", "position")
    return Projection(nodes, facts, replay.supersessions_of(facts), replay.last_retractions(gone), None)


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


# ---- views

FACT_COLUMNS = "id, source, relation, target, valid_from, valid_until, recorded_at, confidence, supersedes"


def _fact_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c.strip() for c in FACT_COLUMNS.split(",")])


@register(f"{sql.BASE} SELECT {FACT_COLUMNS} FROM facts")
def memory_facts(spark, sf_dir):
    return _fact_columns(derived.facts(spark, sf_dir))


@register(f"{sql.BASE}, {sql.active(T98, T98)} SELECT {FACT_COLUMNS} FROM active")
def active_facts(spark, sf_dir):
    return _fact_columns(memory(spark, sf_dir).active_facts(CLOCK))


@register(f"{sql.view(T98, T98)} SELECT {FACT_COLUMNS} FROM view_facts")
def memory_view_facts(spark, sf_dir):
    return _fact_columns(memory(spark, sf_dir).view(T98, T98).facts)


@register(f"{sql.view(T96, T96)} SELECT {FACT_COLUMNS} FROM view_facts")
def memory_view_facts_past(spark, sf_dir):
    return _fact_columns(memory(spark, sf_dir).view(T96, T96).facts)


@register(f"{sql.view(T96, T96)} SELECT {FACT_COLUMNS} FROM view_facts")
def clustered_view_facts_past(spark, sf_dir):
    """An early clock on the projection as it is laid out for clocks: of its cells few are read."""
    laid_out = ClusteredProjection.write(memory(spark, sf_dir), store_path(spark, "clustered"))
    return _fact_columns(laid_out.view(T96, T96).facts)


@register(f"{sql.view(T98, T98)} SELECT id, kind, label, repository, branch, recorded_at FROM nodes")
def memory_view_nodes(spark, sf_dir):
    return memory(spark, sf_dir).view(T98, T98).nodes.select("id", "kind", "label", "repository", "branch", "recorded_at")


@register(f"{sql.BASE}, {sql.nodes(T96)} SELECT id, label, recorded_at FROM nodes")
def node_asof(spark, sf_dir):
    return memory(spark, sf_dir).visible_nodes(T96).select("id", "label", "recorded_at")


@register(
    f"""{sql.BASE}, ranked AS (
  SELECT o_orderkey AS request, 'customer:' || o_custkey AS entity, epoch_us(o_orderdate) AS known_at, label, recorded_at,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY recorded_at DESC, rev DESC) AS n
  FROM orders LEFT JOIN revisions ON id = 'customer:' || o_custkey AND recorded_at <= epoch_us(o_orderdate)
) SELECT request, entity, known_at, label, recorded_at FROM ranked WHERE n = 1"""
)
def customer_as_of_order(spark, sf_dir):
    """Each order's customer as it was known on the day of the order: as many clocks as there are days."""
    o = table(spark, sf_dir, "orders")
    asked = o.select(F.col("o_orderkey").cast("long").alias("request"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity"), derived.micros(F.col("o_orderdate")).alias("known_at"))
    return visible_as_of(memory(spark, sf_dir).node_revisions, asked).select("request", "entity", "known_at", "label", "recorded_at")


_CLOCKS = {"now": (T98, T98), "past": (T96, T96), "hindsight": (T96, T98), "forecast": (T98, T96)}


@register(
    sql.BASE
    + "".join(f", {sql.active(v, k, 'a_' + n)}" for n, (v, k) in _CLOCKS.items())
    + " "
    + " UNION ALL ".join(f"SELECT '{n}' AS clock, relation, count(*) AS n, sum(confidence)::BIGINT AS confidence FROM a_{n} GROUP BY relation" for n in _CLOCKS)
)
def bitemporal_clocks(spark, sf_dir):
    clocks = spark.createDataFrame([(n, v, k) for n, (v, k) in _CLOCKS.items()], "clock string, valid_at bigint, known_at bigint")
    return bitemporal_matrix(memory(spark, sf_dir), clocks).groupBy("clock", "relation").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))


@register(f"{sql.BASE} SELECT fact_id, valid_until, recorded_at FROM retractions")
def last_retraction_wins(spark, sf_dir):
    return memory(spark, sf_dir).retractions


@register(f"{sql.BASE} SELECT prior, replacement FROM supersessions")
def superseded_by(spark, sf_dir):
    return memory(spark, sf_dir).superseded_by


@register(f"{sql.BASE} SELECT f.id, p.id AS prior_id, p.target AS prior_target, f.target, f.valid_from, f.recorded_at FROM facts f JOIN facts p ON p.id = f.supersedes")
def supersession_chain(spark, sf_dir):
    p = memory(spark, sf_dir)
    prior = p.facts.select(F.col("id").alias("prior_id"), F.col("target").alias("prior_target"))
    return p.facts.join(prior, F.col("supersedes") == F.col("prior_id")).select("id", "prior_id", "prior_target", "target", "valid_from", "recorded_at")


# ---- log and replay

_LOG = """WITH log AS (
  SELECT event_id AS global_position, 'event:' || event_id AS id, 'user:' || user_id AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS stream_version, event_type, epoch_us(ts) AS recorded_at FROM events
)"""


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.repartition(tasks_for(e), "user_id")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(
        F.col("event_id").cast("long").alias("global_position"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("stream_id"),
        version.cast("long").alias("stream_version"),
        "event_type",
        derived.micros(F.col("ts")).alias("recorded_at"),
    )


@register("SELECT 'event:' || event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS global_position FROM events")
def event_log_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return with_positions(e, ["event_id"], "global_position").select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), "global_position")


@register(f"{_LOG} SELECT * FROM log WHERE stream_id = 'user:7' AND stream_version > 2")
def load_stream_after(spark, sf_dir):
    return user_log(spark, sf_dir).filter("stream_id = 'user:7' AND stream_version > 2").orderBy("stream_version")


@register(f"{_LOG} SELECT * FROM log WHERE global_position > 100 ORDER BY global_position LIMIT 50")
def load_all_after_limit(spark, sf_dir):
    return user_log(spark, sf_dir).filter("global_position > 100").orderBy("global_position").limit(50)


@register(f"{_LOG} SELECT stream_id, max(stream_version) AS stream_version, count(*) AS n FROM log GROUP BY stream_id")
def stream_versions(spark, sf_dir):
    return user_log(spark, sf_dir).groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"), F.count(F.lit(1)).alias("n"))


@register(
    f"{_LOG} SELECT stream_id, count(*) AS event_count, min(stream_version) AS first_stream_version, max(stream_version) AS last_stream_version,"
    " min(global_position) AS first_global_position, max(global_position) AS last_global_position FROM log GROUP BY stream_id"
)
def append_receipt(spark, sf_dir):
    span = [f(c).alias(f"{n}_{c}") for c in ("stream_version", "global_position") for n, f in (("first", F.min), ("last", F.max))]
    return user_log(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("event_count"), *span)


@register("SELECT event_id // 64 AS batch, min(event_id) AS first_position, max(event_id) AS last_position, count(*) AS n FROM events GROUP BY 1")
def subscription_batches(spark, sf_dir):
    batch = F.expr("global_position div 64").alias("batch")
    ends = [F.min("global_position").alias("first_position"), F.max("global_position").alias("last_position"), F.count(F.lit(1)).alias("n")]
    return user_log(spark, sf_dir).groupBy(batch).agg(*ends)


#: The corrupted log: one event missing, one id used twice.
@register(
    _LOG
    + """, bad AS (
  SELECT CASE WHEN global_position = 700 THEN 'event:600' ELSE id END AS id, stream_id, stream_version, global_position FROM log WHERE global_position <> 500
), v AS (
  SELECT global_position, 1 AS priority, 'DuplicateEvent' AS error FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY global_position) AS n FROM bad) WHERE n > 1
  UNION ALL SELECT global_position, 2, 'InvalidReplay' FROM (SELECT *, lag(global_position, 1, -1) OVER (ORDER BY global_position) AS p FROM bad) WHERE global_position <> p + 1
  UNION ALL SELECT global_position, 3, 'InvalidReplay' FROM (SELECT *, lag(stream_version, 1, -1) OVER (PARTITION BY stream_id ORDER BY global_position) AS p FROM bad) WHERE stream_version <> p + 1
) SELECT * FROM v"""
)
def replay_violations(spark, sf_dir):
    bad = user_log(spark, sf_dir).filter("global_position <> 500").withColumn("id", F.when(F.col("global_position") == 700, "event:600").otherwise(F.col("id")))
    return replay.order_violations(materialize(bad, "log")).select("global_position", "priority", "error")


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with positions; one stream for each stream_id."""
    rows = derived.memory_events(spark, sf_dir)
    return with_positions(rows, ["phase", "recorded_at", "key", "ord"], "global_position", group="stream_id", group_name="stream_version")


@register(f"{sql.view(T98, T98)} SELECT {FACT_COLUMNS} FROM view_facts")
def replayed_view_facts(spark, sf_dir):
    done = replay.replay(materialize(memory_log(spark, sf_dir), "memory-log"), strict=True)
    return _fact_columns(done.projection.view(T98, T98).facts)


@register(f"{sql.view(T98, T98)} SELECT id, kind, label, repository, branch, recorded_at FROM nodes")
def replayed_view_nodes(spark, sf_dir):
    done = replay.replay(materialize(memory_log(spark, sf_dir), "memory-log"), strict=False)
    return done.projection.view(T98, T98).nodes.select("id", "kind", "label", "repository", "branch", "recorded_at")


@register(f"{sql.view(T98, T98)} SELECT {FACT_COLUMNS} FROM view_facts")
def snapshot_resume(spark, sf_dir):
    """A snapshot in the middle of the log, saved and loaded, and the tail after it give what the whole log gives."""
    log = materialize(memory_log(spark, sf_dir), "memory-log")
    middle = log.count() // 2
    head = replay.replay(log.filter(F.col("global_position") < middle), strict=False)
    store = SnapshotStore(spark, store_path(spark, "snapshots"))
    store.save(replay.Snapshot(head.cursor, head.projection))
    done = replay.resume(store.load_latest(), log.filter(F.col("global_position") >= middle), strict=True)
    return _fact_columns(done.projection.view(T98, T98).facts)


#: Dangling log: nodes of nations above 19 never come, and facts of nation 3 come twice.
_MISSING = f"""{sql.BASE}, known AS (SELECT DISTINCT id FROM revisions WHERE NOT (id LIKE 'nation:2_'))
SELECT id AS fact, 'MissingEntity' AS error, CASE WHEN source NOT IN (SELECT id FROM known) THEN 7 ELSE 8 END AS priority FROM facts
WHERE source NOT IN (SELECT id FROM known) OR target NOT IN (SELECT id FROM known)"""


@register(_MISSING)
def replay_missing_entities(spark, sf_dir):
    log = materialize(memory_log(spark, sf_dir).filter("NOT coalesce(payload.node.id LIKE 'nation:2_', false)"), "memory-log")
    found = replay.payload_violations(log).filter("error = 'MissingEntity'").groupBy("global_position", "error").agg(F.min("priority").alias("priority"))
    return found.join(log.select("global_position", F.col("payload.fact.id").alias("fact")), "global_position").select("fact", "error", "priority")


# ---- the store itself

_STORE = """WITH e AS (SELECT *, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id % 2 ELSE 0 END AS half FROM events),
log AS (
  SELECT 'event:' || event_id AS id, 'type:' || event_type AS stream_id, half, event_type, epoch_us(ts) AS recorded_at,
         row_number() OVER (ORDER BY event_type, half, epoch_us(ts), 'event:' || event_id) - 1 AS global_position,
         row_number() OVER (PARTITION BY event_type ORDER BY half, epoch_us(ts), 'event:' || event_id) - 1 AS stream_version
  FROM e
)"""
_STORES: dict[tuple[str, str], tuple[event_log.EventLog, list[tuple]]] = {}


def store_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def event_batch(rows: DataFrame) -> DataFrame:
    """Rows of the events table as events without payload."""
    at, none = derived.micros(F.col("ts")), F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), "event_type", at.alias("occurred_at"), at.alias("recorded_at"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("agent_id"), F.lit("load-1").alias("session_id"), none.alias("correlation_id"), none.alias("causation_id"),
        F.lit(None).cast(schema.PAYLOAD).alias("payload"),
    )


def event_store(spark: SparkSession, sf_dir: str) -> tuple[event_log.EventLog, list[tuple]]:
    """The events table in an event log, a stream for each type (the first comes in two batches), and the
    receipts. It is appended once a session and folder; the log is immutable."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        log, receipts = event_log.EventLog.open(spark, store_path(spark, "event-log")), []
        e = table(spark, sf_dir, "events")
        # One row for each type of event.
        types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
        for n, kind in enumerate(types):
            own, expected = e.filter(F.col("event_type") == kind), event_log.ExpectedVersion.NO_STREAM
            for part in [own.filter("event_id % 2 = 0"), own.filter("event_id % 2 = 1")] if n == 0 else [own]:
                receipt = log.append(f"type:{kind}", expected, event_batch(part))
                receipts.append((f"type:{kind}", receipt.event_count, receipt.first_stream_version, receipt.last_stream_version, receipt.first_global_position, receipt.last_global_position))
                expected = receipt.last_stream_version
        _STORES[key] = (log, receipts)
    return _STORES[key]


@register(f"{_STORE} SELECT id, stream_id, stream_version, global_position FROM log")
def store_positions(spark, sf_dir):
    return event_store(spark, sf_dir)[0].events().select("id", "stream_id", "stream_version", "global_position")


@register(f"{_STORE} SELECT id, stream_version, global_position, recorded_at FROM log WHERE stream_id = 'type:click' AND stream_version > 2")
def store_load_stream(spark, sf_dir):
    return event_store(spark, sf_dir)[0].load_stream("type:click", 2).select("id", "stream_version", "global_position", "recorded_at")


@register(f"{_STORE} SELECT id, stream_id, global_position FROM log WHERE global_position > 100 ORDER BY global_position LIMIT 50")
def store_load_all(spark, sf_dir):
    return event_store(spark, sf_dir)[0].load_all(100, 50).select("id", "stream_id", "global_position")


@register(f"{_STORE} SELECT stream_id, max(stream_version) AS stream_version, (SELECT count(*) FROM log) AS log_events FROM log GROUP BY stream_id UNION ALL SELECT 'type:none', NULL, (SELECT count(*) FROM log)")
def store_stream_versions(spark, sf_dir):
    log, receipts = event_store(spark, sf_dir)
    names = sorted({r[0] for r in receipts}) + ["type:none"]
    return spark.createDataFrame([(n, log.stream_version(n), log.count()) for n in names], "stream_id string, stream_version bigint, log_events bigint")


@register(
    f"{_STORE} SELECT stream_id, count(*) AS event_count, min(stream_version) AS first_stream_version, max(stream_version) AS last_stream_version,"
    " min(global_position) AS first_global_position, max(global_position) AS last_global_position FROM log GROUP BY stream_id, half"
)
def store_append_receipts(spark, sf_dir):
    columns = "stream_id string, event_count bigint, first_stream_version bigint, last_stream_version bigint, first_global_position bigint, last_global_position bigint"
    return spark.createDataFrame(event_store(spark, sf_dir)[1], columns)


def outcome(act: Callable[[], object]) -> str:
    try:
        act()
    except MemoryError_ as error:
        return error.kind
    return "none"


_ATTEMPTS = {
    "stream exists": "VersionConflict", "older version": "VersionConflict", "known id": "DuplicateEvent", "id twice": "DuplicateEvent", "padded id": "InvalidValue",
    "recorded before it occurred": "InvalidValue", "blank stream": "InvalidValue", "too large": "InvalidValue", "empty batch": "none",
}


@register("SELECT attempt, error, (SELECT count(*) FROM events) AS log_events FROM (VALUES " + ", ".join(f"('{a}', '{e}')" for a, e in _ATTEMPTS.items()) + ") AS t(attempt, error)")
def append_conflicts(spark, sf_dir):
    """Appends that must fail leave the log as it is."""
    log = event_store(spark, sf_dir)[0]
    known = log.events().select(*[f.name for f in event_batch(table(spark, sf_dir, "events")).schema]).orderBy("id").limit(2)
    fresh = known.withColumn("id", F.concat(F.lit("new:"), F.col("id")))
    small = event_log.EventLog.open(spark, log.path, event_log.LogOptions(max_batch_rows=1))
    new, any_ = event_log.ExpectedVersion.NO_STREAM, event_log.ExpectedVersion.ANY
    acts = {
        "stream exists": lambda: log.append("type:click", new, fresh),
        "older version": lambda: log.append("type:click", 0, fresh),
        "known id": lambda: log.append("other", any_, known),
        "id twice": lambda: log.append("other", any_, fresh.unionByName(fresh)),
        "padded id": lambda: log.append("other", any_, fresh.withColumn("id", F.concat("id", F.lit(" ")))),
        "recorded before it occurred": lambda: log.append("other", any_, fresh.withColumn("occurred_at", F.col("recorded_at") + 1)),
        "blank stream": lambda: log.append(" ", any_, fresh),
        "too large": lambda: small.append("other", any_, fresh),
        "empty batch": lambda: log.append("other", new, fresh.limit(0)),
    }
    return spark.createDataFrame([(name, outcome(act), log.count()) for name, act in acts.items()], "attempt string, error string, log_events bigint")


@register("SELECT * FROM (VALUES ('whole', 'none'), ('stray batch, strict', 'Corruption'), ('stray batch, truncated', 'none'), ('other content', 'Corruption'), ('missing batch', 'Corruption')) AS t(state, error)")
def log_recovery(spark, sf_dir):
    """What opening and verifying say of damaged logs."""
    path, events = store_path(spark, "damaged-log"), event_batch(table(spark, sf_dir, "events")).orderBy("id").limit(20)
    first = event_log.EventLog.open(spark, path)
    first.append("s", event_log.ExpectedVersion.NO_STREAM, events)
    truncate = event_log.LogOptions(event_log.RecoveryPolicy.TRUNCATE_PARTIAL_TAIL)
    check = lambda options=event_log.LogOptions(): outcome(lambda: event_log.EventLog.open(spark, path, options).verify())
    found = [("whole", check())]
    first.events().write.parquet(f"{path}/batches/00000001-stray")
    found += [("stray batch, strict", check()), ("stray batch, truncated", check(truncate))]
    batch = first._manifests()[0]["batch"]
    other = materialize(first.events().withColumn("event_type", F.upper("event_type")), "other-content")
    other.write.mode("overwrite").parquet(f"{path}/batches/{batch}")
    found.append(("other content", check()))
    first._fs.delete(first._fs_path(f"{path}/batches/{batch}"), True)
    found.append(("missing batch", check(truncate)))
    return spark.createDataFrame(found, "state string, error string")


_POLLS = "(SELECT (count(*) + 7) // 8 FROM events)"


@register(f"{_STORE} SELECT global_position // {_POLLS} AS batch, min(global_position) AS first_position, max(global_position) AS last_position, count(*) AS n FROM log GROUP BY 1")
def store_subscription_batches(spark, sf_dir):
    """Polls and acknowledgements until nothing is left; each batch is polled twice before it is acknowledged."""
    log = event_store(spark, sf_dir)[0]
    consumer, found = CatchUpSubscription(None, -(-log.count() // 8)), []
    while True:
        consumer.poll(log)
        span = consumer.poll(log).agg(F.min("global_position"), F.max("global_position"), F.count(F.lit(1))).first()
        if not span[2]:
            return spark.createDataFrame(found, "batch bigint, first_position bigint, last_position bigint, n bigint")
        consumer.acknowledge(span[1])
        found.append((len(found), *span))


@register(f"{_STORE} SELECT count(*) AS n, count(DISTINCT id) AS ids, max(global_position) AS last_position FROM log")
def stream_delivery(spark, sf_dir):
    """The log through Structured Streaming, by committed batches, twice over one checkpoint."""
    log, target = event_store(spark, sf_dir)[0], store_path(spark, "delivered")
    keep = lambda rows, _: rows.select("id", "global_position").write.mode("append").parquet(target)
    checkpoint = store_path(spark, "stream-checkpoint")
    for _ in range(2):
        for_each_batch(log, checkpoint, keep).awaitTermination()
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("global_position").alias("last_position"))


@register(f"{sql.view(T98, T98)} SELECT {FACT_COLUMNS} FROM view_facts")
def incremental_view_facts(spark, sf_dir):
    log = materialize(memory_log(spark, sf_dir), "memory-log")
    third, state = log.count() // 3, IncrementalProjection()
    for low, high in ((0, third), (third, 2 * third), (2 * third, None)):
        part = log.filter(F.col("global_position") >= low)
        done = state.apply(part if high is None else part.filter(F.col("global_position") < high), strict=False)
    return _fact_columns(done.projection.view(T98, T98).facts)


_EIGHTH = "(SELECT (count(*) + 7) // 8 FROM events)"


@register(f"{_STORE} SELECT global_position // {_EIGHTH} AS batch, min(global_position) AS first_position, max(global_position) AS last_position, count(*) AS n, count(DISTINCT id) AS ids FROM log GROUP BY 1")
def stream_log_batches(spark, sf_dir):
    """The log as a data source, an eighth of its events a micro-batch, by a query that is stopped on the way and
    started again: what each micro-batch brought."""
    log_source.register(spark)
    log, target, checkpoint = event_store(spark, sf_dir)[0], store_path(spark, "micro-batches"), store_path(spark, "stream-checkpoint")
    events = spark.readStream.format(log_source.FORMAT).option("path", log.path).option("max_events", -(-log.count() // 8)).load().select("id", "global_position")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    def begun():
        return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()

    query = begun()
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < 2):
        query.awaitTermination(0.2)
    query.stop()
    query = begun()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.schema("id string, global_position bigint, batch bigint").parquet(target)
    ends = [F.min("global_position").alias("first_position"), F.max("global_position").alias("last_position")]
    return rows.groupBy("batch").agg(*ends, F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@register(f"{_STORE} SELECT id, stream_id, stream_version, global_position FROM log WHERE global_position > 100 AND global_position <= (SELECT count(*) FROM log) // 2")
def log_source_range(spark, sf_dir):
    """A range of positions through the data source as a table."""
    log_source.register(spark)
    log = event_store(spark, sf_dir)[0]
    rows = spark.read.format(log_source.FORMAT).option("path", log.path).option("after", 100).option("upto", log.count() // 2).load()
    return rows.select("id", "stream_id", "stream_version", "global_position")


HOUR = 3_600_000_000


@register(
    f"""{_STORE}, g AS (SELECT *, recorded_at - lag(recorded_at) OVER w AS gap FROM log WINDOW w AS (PARTITION BY stream_id ORDER BY stream_version)),
r AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > {HOUR}) OVER (PARTITION BY stream_id ORDER BY stream_version) AS run FROM g),
runs AS (SELECT stream_id, run, count(*) AS events FROM r GROUP BY ALL)
SELECT stream_id, max(stream_version) AS stream_version, max(global_position) AS global_position, count(*) AS n, greatest(coalesce(max(gap), 0), 0) AS longest_gap,
       (SELECT max(events) FROM runs WHERE runs.stream_id = r.stream_id) AS longest_run FROM r GROUP BY stream_id"""
)
def stream_bursts(spark, sf_dir):
    """A projection that isn't the memory, folded by a query that is stopped on the way and resumed."""
    log, target, checkpoint = event_store(spark, sf_dir)[0], store_path(spark, "bursts"), store_path(spark, "stream-checkpoint")
    fold, size = folds.Bursts(HOUR), -(-log.count() // 4)
    query = folds.project(spark, fold, log.path, target, checkpoint, size)
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
        query.awaitTermination(0.2)
    query.stop()
    query = folds.project(spark, fold, log.path, target, checkpoint, size)
    query.processAllAvailable()
    query.stop()
    return folds.current(spark, fold, target)


def memory_store(spark: SparkSession, sf_dir: str) -> event_log.EventLog:
    """The derived log in an event log, a stream after the other."""
    rows = materialize(derived.memory_events(spark, sf_dir), "memory-events")
    log = event_log.EventLog.open(spark, store_path(spark, "memory-log"))
    columns = [f.name for f in spark.createDataFrame([], schema.EVENT).schema]
    # One row for each stream.
    streams = [r[0] for r in rows.select("stream_id", "phase").distinct().orderBy("phase", "stream_id").collect()]
    for stream in streams:
        log.append(stream, event_log.ExpectedVersion.NO_STREAM, rows.filter(F.col("stream_id") == stream).select(*columns))
    return log


@register(f"{sql.view(T98, T98)} SELECT {FACT_COLUMNS} FROM view_facts")
def streamed_view_facts(spark, sf_dir):
    """The projection as ten micro-batches of a stream leave it in its buckets. (The log is sound; what the checks of
    a batch find is the matter of replay_violations and of the tests.)"""
    log = memory_store(spark, sf_dir)
    store = ProjectionStore(spark, store_path(spark, "projection"))
    query = store.follow(log.path, store_path(spark, "stream-checkpoint"), -(-log.count() // 10), strict=False)
    query.processAllAvailable()
    query.stop()
    return _fact_columns(store.view(T98, T98).facts)


@register(f"SELECT c_custkey, {sql.crc32c('encode(c_name)')} AS crc FROM customer")
def checksums(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", crc32c(F.col("c_name").cast("binary")).alias("crc"))


@register(
    "SELECT codec, c_custkey, c_name, CASE codec WHEN 'json' THEN '7B' WHEN 'lz4' THEN '50414C5A4C5A3431' WHEN 'sealed' THEN CASE WHEN c_custkey % 2 = 0 THEN '056B65792D31' ELSE '056B65792D32' END END AS head"
    " FROM customer, (VALUES ('json'), ('lz4'), ('sealed')) AS t(codec)"
)
def codec_roundtrip(spark, sf_dir):
    """Through JSON, LZ4 and AES-GCM and back; even customers were sealed under an older key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_custkey", "c_name").alias("v"))
    plain = codec.JsonCodec("c_custkey bigint, c_name string")
    packed, old, new = codec.Lz4Codec(plain, 1 << 20), codec.StaticKey("key-1", b"1" * 32), codec.StaticKey("key-2", b"2" * 32)
    before, now = (codec.EncryptedCodec(packed, codec.KeyRing((old, new), k), b"customers", 1 << 20) for k in ("key-1", "key-2"))
    shown = lambda name, data, one, width: data.select(F.lit(name).alias("codec"), "c_custkey", one.decode(F.col("d"))["c_name"].alias("c_name"), F.hex(F.substring("d", 1, width)).alias("head"))
    sealed = c.filter("c_custkey % 2 = 0").select("c_custkey", before.encode(F.col("v")).alias("d")).unionByName(c.filter("c_custkey % 2 = 1").select("c_custkey", now.encode(F.col("v")).alias("d")))
    out = shown("sealed", sealed, now, 6)
    for name, one, width in (("json", plain, 1), ("lz4", packed, 8)):
        out = out.unionByName(shown(name, c.select("c_custkey", one.encode(F.col("v")).alias("d")), one, width))
    return out


#: Facts of every seventh order name another agent than their envelope; nation nodes come as another type.
@register(
    f"{sql.BASE} SELECT id, 'InvalidReplay' AS error, 5 AS priority FROM order_facts WHERE substr(id, 8)::BIGINT % 7 = 0"
    " UNION ALL SELECT 'nation:' || n_nationkey, 'InvalidReplay', 4 FROM nation"
)
def envelope_violations(spark, sf_dir):
    log = memory_log(spark, sf_dir)
    key = F.substring("payload.fact.id", 8, 20).try_cast("bigint")
    other = F.col("payload").withField("fact", F.col("payload.fact").withField("agent_id", F.lit("someone")))
    log = log.withColumn("payload", F.when(F.col("payload.fact.id").startswith("fact:o:") & (key % 7 == 0), other).otherwise(F.col("payload")))
    log = log.withColumn("event_type", F.when(F.col("payload.node.id").startswith("nation:"), "node_seen").otherwise(F.col("event_type")))
    log = materialize(log, "memory-log")
    names = log.select("global_position", F.coalesce("payload.fact.id", "payload.node.id").alias("id"))
    return replay.payload_violations(log).join(names, "global_position").select("id", "error", "priority")


@register(
    f"{sql.BASE}, none AS (SELECT * FROM retractions WHERE false), {sql.active(T98, T98, retractions='none')}, {sql.nodes(T98)}"
    f" SELECT {FACT_COLUMNS} FROM active WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)"
)
def bulk_view_facts(spark, sf_dir):
    """The view of a projection built from its parts: nodes and facts as they are, no log, no retractions."""
    p = memory(spark, sf_dir)
    columns = [c.strip().split(" ")[0] for c in event_log._columns(schema.NODE)]
    nodes = materialize(p.visible_nodes(T98).select(*columns), "bulk-nodes")
    facts = materialize(p.facts.filter(F.col("recorded_at") <= T98).drop("position"), "bulk-facts")
    return _fact_columns(replay.from_parts(nodes, facts, T98).view(T98, T98).facts)


@register(
    f"""{sql.BASE} SELECT 'MissingEntity' AS error, 'nation:' || n_nationkey AS detail FROM nation WHERE n_nationkey >= 20
UNION ALL SELECT 'ConflictingFact', prior FROM supersessions WHERE substr(replacement, 8)::BIGINT % 9 = 0
UNION ALL SELECT 'InvalidValue', fact_id FROM retractions WHERE substr(fact_id, 8)::BIGINT % 33 = 0"""
)
def state_problems(spark, sf_dir):
    """A state without some nodes, with shifted supersessions and with retractions from before their facts."""
    p = memory(spark, sf_dir)
    number = lambda c: F.substring(c, 8, 20).cast("bigint")
    damaged = Projection(
        p.node_revisions.filter("NOT id LIKE 'nation:2_'"),
        p.facts,
        p.supersessions.withColumn("valid_from", F.col("valid_from") + (number("replacement") % 9 == 0).cast("long")),
        p.retractions.withColumn("valid_until", F.when(number("fact_id") % 33 == 0, F.lit(-(10**18))).otherwise(F.col("valid_until"))),
        None,
    )
    return replay.state_problems(damaged)


# ---- graph


@register(f"{sql.view(T98, T98)} SELECT id, label, kind, CASE WHEN repository IS NULL THEN NULL ELSE repository END AS repository, CASE WHEN ck IS NULL THEN NULL ELSE 'CRM-' || ck END AS crm FROM nodes")
def graph_nodes(spark, sf_dir):
    vertices, _ = graph.project_graph(memory(spark, sf_dir).view(T98, T98))
    return vertices.select("id", "label", "kind", F.col("attributes")["memory.repository"].alias("repository"), F.col("attributes")["memory.external_id.crm"].alias("crm"))


_LEVEL = "CASE WHEN confidence >= 9500 THEN 'exact' WHEN confidence >= 8000 THEN 'high' WHEN confidence >= 5000 THEN 'medium' ELSE 'low' END"


@register(
    f"{sql.view(T98, T98)} SELECT id AS fact_id, source, target, relation AS kind, {_LEVEL} AS level, id AS detail, valid_from::VARCHAR AS valid_from, supersedes FROM view_facts"
)
def graph_edges(spark, sf_dir):
    _, edges = graph.project_graph(memory(spark, sf_dir).view(T98, T98))
    a = F.col("attributes")
    return edges.select(a["fact_id"].alias("fact_id"), "source", "target", "kind", F.col("provenance.confidence").alias("level"), F.col("provenance.detail").alias("detail"), a["valid_from"].alias("valid_from"), a["supersedes"].alias("supersedes"))


@register(f"{sql.view(T98, T98)} SELECT {_LEVEL} AS level, count(*) AS n FROM view_facts GROUP BY 1")
def edge_confidence_level(spark, sf_dir):
    return memory(spark, sf_dir).view(T98, T98).facts.groupBy(graph.confidence_level(F.col("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register(f"{sql.BASE} SELECT source AS entity, id AS fact FROM facts UNION ALL SELECT target, id FROM facts WHERE source <> target")
def incidence(spark, sf_dir):
    return memory(spark, sf_dir).incidence()


@register(
    f"{sql.view(T98, T98)} SELECT entity, count(*) AS degree FROM (SELECT source AS entity FROM view_facts UNION ALL SELECT target FROM view_facts WHERE source <> target) GROUP BY entity"
)
def degree(spark, sf_dir):
    p = memory(spark, sf_dir)
    return p.incidence(p.view(T98, T98).facts).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


@register(f"{sql.view(T98, T98)} SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM view_facts) AND id NOT IN (SELECT target FROM view_facts)")
def orphans(spark, sf_dir):
    return graph.orphans(memory(spark, sf_dir).view(T98, T98)).select("id")


def _kept_view(spark, sf_dir):
    """The view of now, written once: traversals read it again for each hop."""
    return memory(spark, sf_dir).view(T98, T98).kept()


@register(
    f"""{sql.view(T98, T98)}, e AS (SELECT source AS a, target AS b FROM view_facts WHERE relation = 'located_in' UNION SELECT target, source FROM view_facts WHERE relation = 'located_in'),
walk(entity, depth) AS (SELECT 'customer:7', 0 UNION SELECT b, depth + 1 FROM walk JOIN e ON a = entity WHERE depth < 2)
SELECT entity, min(depth) AS depth FROM walk GROUP BY entity"""
)
def bfs_undirected_depth2(spark, sf_dir):
    facts = _kept_view(spark, sf_dir).facts.filter("relation = 'located_in'")
    roots = spark.createDataFrame([(0, "customer:7")], "request bigint, entity string")
    return graph.spread(roots, graph.both_ways(facts), 2).select("entity", "depth")


@register(
    f"""{sql.view(T98, T98)}, e AS (SELECT DISTINCT source AS a, target AS b FROM view_facts), r AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier),
walk(root, entity) AS (SELECT id, id FROM r UNION SELECT root, b FROM walk JOIN e ON a = entity)
SELECT root AS entity, count(*) - 1 AS n FROM walk GROUP BY root"""
)
def reachable_counts(spark, sf_dir):
    view = _kept_view(spark, sf_dir)
    roots = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity"))
    return graph.reachable_counts(view.facts, roots)


# ---- analytics

HYPOTHESIS = {"source": "customer:1", "relation": "located_in", "target": "nation:24", "confidence": 8000, "supersedes": "fact:c:2"}
_FOUND = """found AS (
  SELECT id AS fact, target, least(confidence, 8000) AS strength_bps,
         CASE WHEN lower(relation) = 'contradicts' AND ((source = 'customer:1' AND target = 'nation:24') OR (source = 'nation:24' AND target = 'customer:1')) THEN 'explicit contradicts relation'
              WHEN id = 'fact:c:2' THEN 'hypothesis explicitly supersedes this fact' ELSE 'same source and relation assert a different target' END AS reason
  FROM view_facts
  WHERE (source = 'customer:1' AND relation = 'located_in' AND target <> 'nation:24') OR id = 'fact:c:2'
     OR (lower(relation) = 'contradicts' AND ((source = 'customer:1' AND target = 'nation:24') OR (source = 'nation:24' AND target = 'customer:1')))
)"""
_CASCADE = f"""{sql.view(T98, T98)}, {_FOUND}, e AS (SELECT DISTINCT source AS a, target AS b FROM view_facts),
walk(entity, depth) AS (SELECT DISTINCT target, 0 FROM found UNION SELECT b, depth + 1 FROM walk JOIN e ON a = entity WHERE depth < 3),
cascade AS (SELECT entity, min(depth) AS depth FROM walk GROUP BY entity)"""


@register(f"{sql.view(T98, T98)}, {_FOUND} SELECT fact, strength_bps, reason FROM found")
def belief_contradictions(spark, sf_dir):
    return analytics.contradictions(memory(spark, sf_dir).view(T98, T98), HYPOTHESIS).drop("target")


@register(f"{_CASCADE} SELECT entity, depth, 10000 - 8000 // (depth + 2) AS revised_confidence_bps FROM cascade")
def belief_cascade(spark, sf_dir):
    return analytics.belief_revision(memory(spark, sf_dir), HYPOTHESIS, CLOCK, 3)[1]


@register(f"{_CASCADE} SELECT entity FROM cascade JOIN nodes ON id = entity WHERE lower(kind) = 'decision'")
def invalidated_decisions(spark, sf_dir):
    return analytics.belief_revision(memory(spark, sf_dir), HYPOTHESIS, CLOCK, 3)[2]


_DRIFT = f"""{sql.BASE}, k AS (
  SELECT *, lag(id) OVER w AS pid, lag(target) OVER w AS ptarget, lag(confidence) OVER w AS pconf FROM facts WHERE recorded_at <= {T98}
  WINDOW w AS (PARTITION BY source, relation ORDER BY recorded_at, id)
), snaps AS (
  SELECT source, relation, id AS fact, target, recorded_at, confidence AS confidence_bps,
         CASE WHEN pid IS NULL THEN 'initial' WHEN supersedes IS NOT DISTINCT FROM pid OR target <> ptarget THEN 'corrected'
              WHEN confidence > pconf THEN 'reinforced' WHEN confidence < pconf THEN 'weakened' ELSE 'refined' END AS change
  FROM k
)"""


@register(f"{_DRIFT} SELECT * FROM snaps")
def drift_snapshots(spark, sf_dir):
    return analytics.drift(memory(spark, sf_dir), T98)[0]


@register(
    f"""{_DRIFT}, s AS (SELECT source, relation, count(*) AS n, count(*) FILTER (change = 'corrected') AS correction_count FROM snaps GROUP BY ALL),
t AS (SELECT *, CASE WHEN n <= 1 THEN 10000 ELSE 10000 - least(10000, (6000 * correction_count + 1000 * (n - 1 - correction_count)) // (n - 1)) END AS stability_bps FROM s)
SELECT *, correction_count >= 2 OR stability_bps < 6000 AS likely_to_change FROM t"""
)
def drift_summary(spark, sf_dir):
    return analytics.drift(memory(spark, sf_dir), T98)[1]


MINIMUM, FLOOR, UNSTABLE, STALE = 2, 3000, 3, 365 * derived.DAY
_SUPPORT = "support AS (SELECT target AS entity, count(*) AS supports FROM view_facts WHERE lower(relation) IN ('supports', 'supported_by', 'caused_by') GROUP BY target)"
_NODE_GAPS = f"""node_gaps AS (
  SELECT id AS entity, NULL::VARCHAR AS fact, CASE WHEN lower(kind) = 'decision' THEN 'unjustified_decision' ELSE 'single_source_inference' END AS kind,
         CASE WHEN lower(kind) = 'decision' THEN 10000 ELSE least(10000, ({MINIMUM} - coalesce(supports, 0)) * 10000 // {MINIMUM}) END AS severity_bps
  FROM nodes LEFT JOIN support ON entity = id
  WHERE (lower(kind) = 'decision' AND coalesce(supports, 0) = 0) OR (lower(kind) = 'inference' AND coalesce(supports, 0) < {MINIMUM})
)"""
_FACT_GAPS = f"""weak_gaps AS (SELECT target AS entity, id AS fact, 'low_confidence_foundation' AS kind, 10000 - confidence AS severity_bps FROM view_facts WHERE confidence < {FLOOR}),
stale_gaps AS (SELECT target AS entity, id AS fact, 'stale_evidence' AS kind, least(10000, greatest(1000, (({T98} - recorded_at)::HUGEINT * 5000) // {STALE}))::BIGINT AS severity_bps FROM view_facts WHERE {T98} - recorded_at >= {STALE})"""
_UNSTABLE = f"""unstable AS (
  SELECT source AS entity, arg_max(id, (recorded_at, id)) AS fact, 'unstable_knowledge' AS kind, least(10000, 2000 * count(*)) AS severity_bps
  FROM facts WHERE recorded_at <= {T98} GROUP BY source, relation HAVING count(*) >= {UNSTABLE} AND count(supersedes) + 1 >= {UNSTABLE}
)"""
_GAPS = f"""{sql.view(T98, T98)}, {_SUPPORT}, {_NODE_GAPS}, {_FACT_GAPS}, {_UNSTABLE},
gaps AS (SELECT * FROM node_gaps UNION ALL SELECT * FROM weak_gaps UNION ALL SELECT * FROM stale_gaps UNION ALL SELECT * FROM unstable)"""


@register(f"{_GAPS} SELECT entity, fact, kind, severity_bps FROM node_gaps")
def support_gaps(spark, sf_dir):
    return analytics.node_gaps(memory(spark, sf_dir).view(T98, T98), MINIMUM)


@register(f"{_GAPS} SELECT * FROM weak_gaps UNION ALL SELECT * FROM stale_gaps")
def confidence_and_stale_gaps(spark, sf_dir):
    return analytics.fact_gaps(memory(spark, sf_dir).view(T98, T98), CLOCK, FLOOR, STALE)


@register(f"{_GAPS} SELECT * FROM unstable")
def unstable_gaps(spark, sf_dir):
    return analytics.unstable_gaps(memory(spark, sf_dir), T98, UNSTABLE)


@register(
    f"""{_GAPS}, e AS (SELECT DISTINCT source AS a, target AS b FROM view_facts), roots AS (SELECT DISTINCT entity AS id FROM gaps WHERE entity IN (SELECT id FROM nodes)),
walk(root, entity) AS (SELECT id, id FROM roots UNION SELECT root, b FROM walk JOIN e ON a = entity),
reach AS (SELECT root, count(*) - 1 AS downstream_entities FROM walk GROUP BY root)
SELECT entity, fact, kind, severity_bps, coalesce(downstream_entities, 0) AS downstream_entities FROM gaps LEFT JOIN reach ON root = entity
ORDER BY severity_bps DESC, downstream_entities DESC, entity, list_position(['unjustified_decision', 'single_source_inference', 'low_confidence_foundation', 'unstable_knowledge', 'stale_evidence'], kind), fact NULLS FIRST
LIMIT 100"""
)
def gap_report(spark, sf_dir):
    return analytics.reasoning_gaps(memory(spark, sf_dir), CLOCK, MINIMUM, FLOOR, UNSTABLE, STALE, 100)[0].select("entity", "fact", "kind", "severity_bps", "downstream_entities")


@register(
    f"""{_GAPS}, c AS (SELECT (SELECT count(*) FROM gaps) AS total_gaps, (SELECT count(*) FROM nodes) AS analyzed_entities, (SELECT count(*) FROM view_facts) AS analyzed_facts)
SELECT 10000 - least(10000, total_gaps * 10000 // analyzed_entities) AS health_bps, analyzed_entities, analyzed_facts, total_gaps FROM c"""
)
def gap_health(spark, sf_dir):
    view, gaps = analytics.all_gaps(memory(spark, sf_dir), CLOCK, MINIMUM, FLOOR, UNSTABLE, STALE)
    return analytics.gap_health(view, gaps)


_ACTIONS = f"""{sql.view(T98, T98)}, dups AS (
  SELECT 'supersede_duplicate' AS kind, list(id ORDER BY confidence DESC, recorded_at DESC, id) AS ids, [source, target] AS ents FROM view_facts GROUP BY source, relation, target HAVING count(*) > 1
), lonely AS (
  SELECT 'review_orphan' AS kind, []::VARCHAR[] AS ids, [id] AS ents FROM nodes WHERE id NOT IN (SELECT source FROM view_facts) AND id NOT IN (SELECT target FROM view_facts)
), chains AS (
  SELECT 'compact_revision_chain' AS kind, list(id ORDER BY recorded_at, id) AS ids, [source] AS ents FROM facts WHERE recorded_at <= {T98} GROUP BY source, relation HAVING count(supersedes) >= 3
), actions AS (
  SELECT kind, ids[1] AS keep, ids, ents FROM dups UNION ALL SELECT kind, NULL, ids, ents FROM lonely UNION ALL SELECT kind, ids[-1], ids, ents FROM chains
), top AS (
  SELECT * FROM actions ORDER BY list_position(['supersede_duplicate', 'review_orphan', 'compact_revision_chain'], kind), ents, ids LIMIT 120
)"""
_SHOWN = "kind, keep, array_to_string(ids, ',') AS affected_facts, array_to_string(ents, ',') AS affected_entities"


def _actions(df: DataFrame) -> DataFrame:
    return df.select("kind", "keep", joined("affected_facts"), joined("affected_entities"))


@register(f"{_ACTIONS} SELECT {_SHOWN} FROM actions WHERE kind = 'supersede_duplicate'")
def duplicate_actions(spark, sf_dir):
    return _actions(analytics.duplicate_actions(memory(spark, sf_dir).view(T98, T98)))


@register(f"{_ACTIONS} SELECT {_SHOWN} FROM actions WHERE kind = 'compact_revision_chain'")
def revision_chain_actions(spark, sf_dir):
    return _actions(analytics.revision_chain_actions(memory(spark, sf_dir), T98))


@register(f"{_ACTIONS} SELECT {_SHOWN} FROM top")
def consolidation_plan(spark, sf_dir):
    return _actions(analytics.consolidation_plan(memory(spark, sf_dir), CLOCK, 120)[0])


@register(f"{_ACTIONS} SELECT coalesce(sum(CASE WHEN kind = 'review_orphan' THEN 0 ELSE len(ids) - 1 END), 0)::BIGINT AS projected_savings FROM top")
def projected_savings(spark, sf_dir):
    return analytics.consolidation_plan(memory(spark, sf_dir), CLOCK, 120)[1].select("projected_savings")


# ---- context


@register(f"{sql.view(T98, T98)} SELECT id, {sql.node_tokens()} AS tokens FROM nodes")
def node_tokens(spark, sf_dir):
    return memory(spark, sf_dir).visible_nodes(T98).select("id", node_tokens_of().alias("tokens"))


@register(f"{sql.BASE} SELECT id, {sql.fact_tokens()} AS tokens FROM facts")
def fact_token_counts(spark, sf_dir):
    return derived.facts(spark, sf_dir).select("id", fact_tokens().alias("tokens"))


REQUEST = context.ContextRequest(("customer:4", "customer:8"), T98, T98, 2000, max_depth=2, relations=("located_in", "supports", "supported_by"))
SCOPED = context.ContextRequest(("customer:3",), T98, T98, 2000, max_depth=2, relations=("supports", "supported_by", "located_in"), branches=("main",))
_CONTEXT = f"""{sql.view(T98, T98)}, ok AS (SELECT * FROM view_facts WHERE relation IN ('located_in', 'supports', 'supported_by')),
e AS (SELECT source AS a, target AS b FROM ok UNION SELECT target, source FROM ok),
walk(entity, depth) AS (SELECT * FROM (VALUES ('customer:4', 0), ('customer:8', 0)) UNION SELECT b, depth + 1 FROM walk JOIN e ON a = entity WHERE depth < 2),
reach AS (SELECT entity, min(depth) AS depth FROM walk GROUP BY entity),
candidates AS (SELECT ok.*, least(r1.depth, r2.depth) AS distance FROM ok JOIN reach r1 ON r1.entity = source JOIN reach r2 ON r2.entity = target),
nt AS (SELECT id AS nid, {sql.node_tokens()} AS nt FROM nodes),
ranked AS (SELECT *, {sql.fact_tokens()} AS ft, row_number() OVER (ORDER BY distance, confidence DESC, recorded_at DESC, id) AS n FROM candidates),
priced AS (SELECT n, id, source, target, ft, a.nt AS snt, b.nt AS tnt FROM ranked JOIN nt a ON a.nid = source JOIN nt b ON b.nid = target),
pack(n, used, taken, facts, omitted) AS (
  SELECT 0::BIGINT, (SELECT sum(nt) FROM nt WHERE nid IN ('customer:4', 'customer:8'))::BIGINT, ['customer:4', 'customer:8'], []::VARCHAR[], 0::BIGINT
  UNION ALL
  SELECT q.n, CASE WHEN fits THEN used + price ELSE used END, CASE WHEN fits THEN list_distinct(list_concat(taken, [q.source, q.target])) ELSE taken END,
         CASE WHEN fits THEN list_append(facts, q.id) ELSE facts END, CASE WHEN fits THEN omitted ELSE omitted + 1 END
  FROM (SELECT p.*, pack.used, pack.taken, pack.facts, pack.omitted,
               p.ft + CASE WHEN list_contains(pack.taken, p.source) THEN 0 ELSE p.snt END + CASE WHEN list_contains(pack.taken, p.target) THEN 0 ELSE p.tnt END AS price,
               pack.used + p.ft + CASE WHEN list_contains(pack.taken, p.source) THEN 0 ELSE p.snt END + CASE WHEN list_contains(pack.taken, p.target) THEN 0 ELSE p.tnt END <= 2000 AS fits
        FROM pack JOIN priced p ON p.n = pack.n + 1) q
), final AS (SELECT * FROM pack ORDER BY n DESC LIMIT 1)"""


@register(f"{_CONTEXT} SELECT id, distance FROM candidates")
def context_candidates(spark, sf_dir):
    view = _kept_view(spark, sf_dir)
    seeds = spark.createDataFrame([(0, s) for s in REQUEST.seeds], "request bigint, entity string")
    return context.neighbourhood(view, seeds, REQUEST).candidates.select("id", "distance")


@register(
    f"""{sql.view(T98, T98)}, ok AS (SELECT * FROM view_facts WHERE relation IN ('located_in', 'supports', 'supported_by')),
open AS (SELECT id FROM nodes WHERE branch = 'main'), e AS (SELECT source AS a, target AS b FROM ok UNION SELECT target, source FROM ok),
walk(entity, depth) AS (SELECT 'customer:3', 0 UNION SELECT b, depth + 1 FROM walk JOIN e ON a = entity WHERE depth < 2 AND b IN (SELECT id FROM open)),
reach AS (SELECT DISTINCT entity FROM walk)
SELECT count(DISTINCT id) AS excluded FROM ok WHERE (source IN (FROM reach) AND target NOT IN (FROM open)) OR (target IN (FROM reach) AND source NOT IN (FROM open))"""
)
def context_excluded(spark, sf_dir):
    view = _kept_view(spark, sf_dir)
    seeds = spark.createDataFrame([(0, "customer:3")], "request bigint, entity string")
    return context.neighbourhood(view, seeds, SCOPED).excluded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("excluded"))


@register(f"{_CONTEXT} SELECT unnest(facts) AS id, 'fact' AS kind FROM final UNION ALL SELECT unnest(taken), 'node' FROM final")
def context_pack(spark, sf_dir):
    bundle = context.compile_context(memory(spark, sf_dir), REQUEST)
    return bundle.facts.select("id", F.lit("fact").alias("kind")).unionByName(bundle.nodes.select("id", F.lit("node").alias("kind")))


@register(
    f"{_CONTEXT} SELECT used AS estimated_tokens, len(facts) + omitted AS examined_facts, len(taken) AS selected_nodes, len(facts) AS selected_facts, omitted AS omitted_by_budget, 0 AS excluded_by_scope FROM final"
)
def context_receipt(spark, sf_dir):
    receipt = context.compile_context(memory(spark, sf_dir), REQUEST).receipt
    return receipt.select("estimated_tokens", "examined_facts", "selected_nodes", "selected_facts", "omitted_by_budget", "excluded_by_scope")


# ---- retrieval


def part_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers over customers: hits with ties, repeats and two channels."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    entity = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    hit = lambda name, channel, score: c.select(F.lit(name).alias("provider"), entity.alias("entity"), F.lit(channel).alias("channel"), score.cast("long").alias("score"))
    k = F.col("c_custkey")
    return hit("words", "lexical", k * 7 % 101).unionByName(hit("words", "literal", k * 5 % 101)).unionByName(hit("vectors", "semantic", k * 13 % 97)).unionByName(hit("mixed", "hybrid", k % 10))


_HITS = """WITH hits AS (
  SELECT 'words' AS provider, 'customer:' || c_custkey AS entity, 'lexical' AS channel, c_custkey * 7 % 101 AS score FROM customer
  UNION ALL SELECT 'words', 'customer:' || c_custkey, 'literal', c_custkey * 5 % 101 FROM customer
  UNION ALL SELECT 'vectors', 'customer:' || c_custkey, 'semantic', c_custkey * 13 % 97 FROM customer
  UNION ALL SELECT 'mixed', 'customer:' || c_custkey, 'hybrid', c_custkey % 10 FROM customer
), o AS (SELECT *, list_position(['literal', 'lexical', 'semantic', 'hybrid'], channel) AS ch FROM hits),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, entity ORDER BY score DESC, ch) AS n FROM o) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, entity, ch) AS rank FROM b),
f AS (SELECT entity, provider, rank, 1000000000 // (60 + rank) AS contribution FROM r WHERE rank <= 40),
s AS (SELECT entity, sum(contribution)::BIGINT AS fused_score, string_agg(provider || ':' || rank, ',' ORDER BY provider) AS sources FROM f GROUP BY entity)
SELECT entity, fused_score, sources FROM s ORDER BY fused_score DESC, entity LIMIT 40"""


@register(_HITS)
def rrf_fusion(spark, sf_dir):
    shown = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["provider"], s["rank"].cast("string"))), ",")
    return retrieval.fuse(part_hits(spark, sf_dir), 40).select("entity", "fused_score", shown.alias("sources"))


#: Queries: every hundredth vector against all.
@register(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT query_id, vec_id AS id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 1000000)::BIGINT AS score
  FROM q, embeddings
) SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 5"""
)
def semantic_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    return retrieval.nearest(e, asked, 5)


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: strlen(t) > 1))"
_ASKED = "array_to_string(string_split((SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), ' ')[1:6], ' ')"


def first_words(spark: SparkSession, sf_dir: str) -> retrieval.RetrievalQuery:
    """The first words of the first benchmark item."""
    words = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.array_join(F.slice(F.split("text", " "), 1, 6), " ")).first()[0]
    return retrieval.RetrievalQuery(words, 10)


@register(
    f"SELECT 'b' || item_id AS entity, 'literal' AS channel, len(list_intersect({_TOKENS.format('text')}, {_TOKENS.format(_ASKED)})) AS score FROM benchmark"
    f" WHERE len(list_intersect({_TOKENS.format('text')}, {_TOKENS.format(_ASKED)})) > 0"
)
def literal_hits(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("entity"), "text")
    hits = retrieval.collect_hits([retrieval.LiteralProvider(texts)], first_words(spark, sf_dir))
    return hits.select("entity", "channel", "score")


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: strlen(t) > 1)"


@register(
    f"""WITH d AS (SELECT 'd' || doc_id AS entity, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), z AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d),
q AS (SELECT unnest({_TOKENS.format(_ASKED)}) AS term), t AS (SELECT entity, len(ws) AS n, unnest(ws) AS term FROM d),
c AS (SELECT entity, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT entity, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) * 1000000)::BIGINT AS score FROM c JOIN f USING (term), z GROUP BY entity)
SELECT entity, 'lexical' AS channel, score FROM s ORDER BY score DESC, entity LIMIT 10"""
)
def lexical_hits(spark, sf_dir):
    """The best documents for the first benchmark item's first words, by a stored index of which only the query's
    terms are read."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("entity"), "text")
    index = LexicalIndex.build(texts, store_path(spark, "lexical-index"))
    return retrieval.collect_hits([IndexedProvider(index)], first_words(spark, sf_dir)).select("entity", "channel", "score")


PLACES = ExtractionRules(mentions=(("person", r"Customer#\d+"), ("place", r"(?<= lives in )[^,]+")), relations=(("lives_in", r"(Customer#\d+) lives in ([^,]+)"),), confidence=9000)
_LIVES = "SELECT c_custkey, c_name, n_name, c_name || ' lives in ' || n_name || ', says ' || c_name AS content FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _lives(spark: SparkSession, sf_dir: str) -> None:
    """The view extraction_inputs (input_id, content) and the table functions of PLACES."""
    table_functions.register(spark, PLACES)
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows.selectExpr("concat('doc:', c_custkey) AS input_id", "concat(c_name, ' lives in ', n_name, ', says ', c_name) AS content").createOrReplaceTempView("extraction_inputs")


@register(
    f"""WITH t AS ({_LIVES}) SELECT 'doc:' || c_custkey AS input_id, 'm0' AS local_id, 'person' AS kind, c_name AS label, 0::BIGINT AS low, strlen(c_name)::BIGINT AS high FROM t
UNION ALL SELECT 'doc:' || c_custkey, 'm1', 'place', n_name, strlen(c_name) + 10, strlen(c_name) + 10 + strlen(n_name) FROM t"""
)
def sql_extracted_mentions(spark, sf_dir):
    """Extraction written in Spark SQL, by a table function over a view."""
    _lives(spark, sf_dir)
    return spark.sql("SELECT input_id, local_id, kind, label, span.start AS low, span.end AS high FROM extract_mentions(TABLE(extraction_inputs) PARTITION BY input_id)")


@register(f"WITH t AS ({_LIVES}) SELECT n_name AS place, count(*) AS people, min(c_name) AS first FROM t GROUP BY n_name")
def sql_extracted_relations(spark, sf_dir):
    _lives(spark, sf_dir)
    return spark.sql(
        """SELECT p.label AS place, count(*) AS people, min(s.label) AS first FROM extract_relations(TABLE(extraction_inputs) PARTITION BY input_id) r
        JOIN extract_mentions(TABLE(extraction_inputs) PARTITION BY input_id) p ON p.input_id = r.input_id AND p.local_id = r.target
        JOIN extract_mentions(TABLE(extraction_inputs) PARTITION BY input_id) s ON s.input_id = r.input_id AND s.local_id = r.source
        WHERE r.relation = 'lives_in' GROUP BY p.label"""
    )


_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@register(
    f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT 'v' || vec_id AS entity, 'semantic' AS channel,"
    f" round({_DOT.format('v', 'embedding')} / sqrt({_DOT.format('v', 'v')} * {_DOT.format('embedding', 'embedding')}) * 1000000)::BIGINT AS score FROM q, embeddings"
)
def semantic_hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.orderBy("vec_id").select("embedding").first()[0]
    vectors = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("entity"), F.col("embedding").alias("vector"))
    return retrieval.collect_hits([retrieval.CosineProvider(vectors, list(asked))], retrieval.RetrievalQuery("near", 10)).select("entity", "channel", "score")


@register(
    """SELECT 'hit' AS kind, 'customer:' || c_custkey AS id FROM customer WHERE c_custkey IN (4, 8) UNION ALL SELECT 'node', 'customer:' || c_custkey FROM customer WHERE c_custkey IN (4, 8)
UNION ALL SELECT 'fact', 'fact:c:' || c_custkey FROM customer WHERE c_custkey IN (4, 8) UNION ALL SELECT DISTINCT 'node', 'nation:' || c_nationkey FROM customer WHERE c_custkey IN (4, 8)"""
)
def retrieved_context(spark, sf_dir):
    """Two customers found by their labels, and the nations in which they are."""
    p = memory(spark, sf_dir)
    labels = p.visible_nodes(T98).select(F.col("id").alias("entity"), F.col("label").alias("text"))
    request = context.ContextRequest(("replaced",), T98, T98, 2000, max_depth=1, relations=("located_in",))
    bundle = context.compile_with_retrieval(p, request, retrieval.RetrievalQuery("Customer 000000004 000000008", 2), [retrieval.LiteralProvider(labels)])
    row = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("id"))
    return row(bundle.retrieval, "hit", "entity").unionByName(row(bundle.nodes, "node", "id")).unionByName(row(bundle.facts, "fact", "id"))


_CHECKS = {
    "context without seeds": "InvalidValue", "context without budget": "InvalidValue", "context of negative depth": "InvalidValue", "context of an unknown seed": "MissingEntity",
    "context of a small budget": "BudgetTooSmall", "padded query": "InvalidValue", "query without limit": "InvalidValue", "unknown channel": "InvalidValue", "channel included twice": "none",
    "provider twice": "InvalidValue", "provider fails": "Retrieval", "cutoff zero": "InvalidValue", "prediction of an unknown case": "InvalidValue", "sound evaluation": "none",
    "subscription without size": "InvalidValue", "acknowledged before a poll": "InvalidValue", "repeated log": "DuplicateEvent", "sound log": "none",
}


class FailingProvider:
    name = "failing"

    def retrieve(self, query: retrieval.RetrievalQuery) -> DataFrame:
        raise OSError("unreachable")


@register("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{e}')" for a, e in _CHECKS.items()) + ") AS t(asked, error)")
def request_checks(spark, sf_dir):
    """What requests that break a rule are answered with."""
    p, query = memory(spark, sf_dir), retrieval.RetrievalQuery("words", 3)
    request = lambda seeds=("customer:1",), budget=500, depth=1: context.ContextRequest(seeds, T98, T98, budget, max_depth=depth)
    documents, cases = benchmark_cases(spark, sf_dir)
    predicted = evaluation.literal_predictions(cases, documents, 2)
    texts = retrieval.LiteralProvider(documents.select(F.col("id").alias("entity"), "text"))
    log = user_log(spark, sf_dir).withColumn("payload", F.lit(None).cast(schema.PAYLOAD))
    acts = {
        "context without seeds": lambda: request(seeds=()),
        "context without budget": lambda: request(budget=0),
        "context of negative depth": lambda: request(depth=-1),
        "context of an unknown seed": lambda: context.compile_context(p, request(("customer:none",))),
        "context of a small budget": lambda: context.compile_context(p, request(budget=1, depth=0)),
        "padded query": lambda: retrieval.RetrievalQuery(" words", 3),
        "query without limit": lambda: retrieval.RetrievalQuery("words", 0),
        "unknown channel": lambda: retrieval.RetrievalQuery("words", 3, ("smell",)),
        "channel included twice": lambda: query.include("lexical").include("lexical"),
        "provider twice": lambda: retrieval.collect_hits([texts, texts], query),
        "provider fails": lambda: retrieval.collect_hits([texts, FailingProvider()], query),
        "cutoff zero": lambda: evaluation.validate(cases, predicted, [0]),
        "prediction of an unknown case": lambda: evaluation.validate(cases, predicted.withColumn("case_id", F.lit("none")).limit(1), [1]),
        "sound evaluation": lambda: evaluation.validate(cases, predicted, [1]),
        "subscription without size": lambda: CatchUpSubscription(None, 0),
        "acknowledged before a poll": lambda: CatchUpSubscription(None, 1).acknowledge(0),
        "repeated log": lambda: replay.raise_first(replay.order_violations(log.unionByName(log.filter("global_position = 0").withColumn("global_position", F.lit(1).cast("long"))))),
        "sound log": lambda: replay.raise_first(replay.order_violations(log)),
    }
    return spark.createDataFrame([(name, outcome(act)) for name, act in acts.items()], "asked string, error string")


# ---- linking


def customer_mentions(spark: SparkSession, sf_dir: str, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """One input a customer (every: or those of branch main alone) with three mentions: its label in its
    scope, its external id, a stranger."""
    c = table(spark, sf_dir, "customer").filter(F.lit(True) if every else F.expr("c_custkey % 3 = 0")).select("c_custkey", "c_name", "c_mktsegment")
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    kind = derived._of(derived.KIND, F.col("c_mktsegment"))
    input_id = F.concat(F.lit("doc:"), k.cast("string"))
    inputs = c.select(
        input_id.alias("input_id"), F.lit("crm").alias("source"), F.concat("c_name", F.lit(" wrote")).alias("content"), F.col("c_mktsegment").alias("repository"), F.lit("main").alias("branch"),
        F.lit(T97).cast("long").alias("occurred_at"), F.lit(T98).cast("long").alias("recorded_at"), F.lit("agent").alias("agent_id"), F.lit("s1").alias("session_id"), none.alias("locator"), none.alias("digest"),
    )
    empty = F.create_map().cast("map<string,string>")
    hint = F.array().cast("array<struct<entity_id:string,confidence:int,source:string>>")
    span = F.lit(None).cast("struct<start:int,end:int>")
    mention = lambda n, label, kind_, attributes, aliases, conf: c.select(
        input_id.alias("input_id"), F.lit(n).alias("ordinal"), F.lit(f"m{n}").alias("local_id"), kind_.alias("kind"), label.alias("label"), F.lit(conf).alias("confidence"), none.alias("stable_id"),
        aliases.alias("aliases"), attributes.alias("attributes"), hint.alias("hints"), span.alias("span"),
    )
    no_alias = F.array().cast("array<string>")
    external = F.create_map(F.lit("external_id.crm"), F.concat(F.lit("crm-"), k.cast("string")))
    mentions = (
        mention(0, F.upper(F.replace("c_name", F.lit("#"), F.lit("  "))), kind, empty, no_alias, 10_000)
        .unionByName(mention(1, F.lit("someone"), kind, external, no_alias, 9_900))
        .unionByName(mention(2, F.concat(F.lit("Stranger "), k.cast("string")), F.lit("Person"), empty, F.array(F.concat(F.lit("S"), k.cast("string"))), 9_000))
    )
    return inputs, mentions


_ALL_LINKS = f"""{sql.BASE}, {sql.nodes(T98)}, m AS (
  SELECT c_custkey AS k, 'doc:' || c_custkey AS input_id, c_mktsegment AS repo, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'decision' WHEN 'BUILDING' THEN 'inference' WHEN 'FURNITURE' THEN 'observation' WHEN 'HOUSEHOLD' THEN 'task' WHEN 'MACHINERY' THEN 'file' END AS kind,
         trim(lower(regexp_replace(c_name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM customer
), n AS (SELECT id, kind, repository, branch, ck, trim(lower(regexp_replace(label, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM nodes),
c AS (
  SELECT input_id, 'm0' AS local_id, id AS entity_id, least(10000, greatest(0, 9000 + CASE WHEN repository = repo THEN 400 WHEN repository IS NULL THEN -300 ELSE -2000 END + CASE WHEN branch = 'main' THEN 200 WHEN branch IS NULL THEN -100 ELSE -700 END)) AS score,
         CASE WHEN repository = repo OR branch = 'main' THEN 'scoped_label' ELSE 'label' END AS method FROM m JOIN n ON n.kind = m.kind AND n.key = m.key
  UNION ALL
  SELECT input_id, 'm1', id, least(9900, least(10000, 9700 + CASE WHEN repository = repo THEN 400 WHEN repository IS NULL THEN -300 ELSE -2000 END + CASE WHEN branch = 'main' THEN 200 WHEN branch IS NULL THEN -100 ELSE -700 END)), 'external_id' FROM m JOIN n ON n.kind = m.kind AND n.ck = m.k
)"""


@register(f"{_ALL_LINKS} SELECT * FROM c")
def link_candidates_all(spark, sf_dir):
    inputs, mentions = customer_mentions(spark, sf_dir)
    return linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98)).candidates(mentions, inputs)


@register(
    f"""{_ALL_LINKS}, a AS (SELECT input_id, unnest(['m0', 'm1', 'm2']) AS local_id FROM m),
d AS (SELECT a.input_id, a.local_id, c.entity_id, c.score, c.method FROM a LEFT JOIN c USING (input_id, local_id))
SELECT input_id, local_id, CASE WHEN score >= 8000 THEN entity_id END AS entity_id, CASE WHEN score >= 8000 THEN score ELSE 0 END AS score, CASE WHEN score >= 8000 THEN method ELSE 'unresolved' END AS method FROM d"""
)
def link_decisions_all(spark, sf_dir):
    inputs, mentions = customer_mentions(spark, sf_dir)
    catalog = linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98))
    return catalog.link(mentions, inputs, linking.LinkPolicy(create_unmatched=False))[0].drop("ordinal")


@register("SELECT doc_id, trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))) AS normal FROM documents")
def normalized_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("normal"))


@register(
    """WITH p AS (SELECT c_custkey, encode(c_name) AS b FROM customer), q AS (
  SELECT c_custkey, list_concat(list_transform(range(8), lambda i: ((octet_length(b) >> (8 * i)) & 255)::INTEGER), list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b)[2 * i - 1:2 * i])::INTEGER)) AS bytes FROM p
) SELECT c_custkey, printf('%016x', list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(bytes, lambda x: x::HUGEINT)), lambda a, x: ((xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))) AS hash FROM q"""
)
def stable_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", stable_hash(F.col("c_name")).alias("hash"))


class CustomerProvider:
    """Extraction output made from customer_mentions, with one relation between two mentions."""

    name = "customers"

    def __init__(self, mentions: DataFrame):
        self.mentions = mentions

    def extract(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        none = F.lit(None).cast("long")
        relations = inputs.select(
            "input_id", F.lit(0).alias("ordinal"), F.lit("r0").alias("local_id"), F.lit("m0").alias("source"), F.lit("knows").alias("relation"), F.lit("m2").alias("target"), F.lit(9_500).alias("confidence"),
            none.alias("valid_from"), none.alias("valid_until"), F.lit(None).cast("struct<start:int,end:int>").alias("span"),
        )
        return self.mentions, relations


@register(
    f"""{_ALL_LINKS}, k AS (SELECT DISTINCT input_id, max(score) AS score FROM c WHERE local_id = 'm0' GROUP BY input_id)
SELECT input_id, 'node_upserted' AS event_type, 9000 AS confidence, 1 AS n FROM m
UNION ALL SELECT m.input_id, 'fact_recorded', CASE WHEN k.score >= 8000 THEN least(9000, k.score) ELSE 9000 END, 1 FROM m LEFT JOIN k USING (input_id)
UNION ALL SELECT m.input_id, 'node_upserted', 10000, 1 FROM m LEFT JOIN k USING (input_id) WHERE coalesce(k.score, 0) < 8000"""
)
def extraction_events_all(spark, sf_dir):
    """Kinds of planned events by input; a node's confidence is that of its mention."""
    inputs, mentions = customer_mentions(spark, sf_dir)
    catalog = linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98))
    done = linking.plan(CustomerProvider(mentions), inputs, catalog)
    score = done.links.filter("method = 'created'").select("input_id", F.col("entity_id").alias("node_id"), "score")
    rows = done.events.withColumn("node_id", F.col("payload.node.id")).join(score, ["input_id", "node_id"], "left")
    return rows.select("input_id", "event_type", F.coalesce("payload.fact.confidence", "score").alias("confidence"), F.lit(1).alias("n"))


#: Three rows as first registered, with their SQL: customers of branch main alone.
_LINKS = f"""{sql.BASE}, {sql.nodes(T98)}, m AS (
  SELECT c_custkey AS k, 'doc:' || c_custkey AS input_id, c_mktsegment AS repo, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'decision' WHEN 'BUILDING' THEN 'inference' WHEN 'FURNITURE' THEN 'observation' WHEN 'HOUSEHOLD' THEN 'task' WHEN 'MACHINERY' THEN 'file' END AS kind,
         trim(lower(regexp_replace(c_name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM customer WHERE c_custkey % 3 = 0
), n AS (SELECT id, kind, repository, branch, ck, trim(lower(regexp_replace(label, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM nodes),
c AS (
  SELECT input_id, 'm0' AS local_id, id AS entity_id, least(10000, greatest(0, 9000 + CASE WHEN repository = repo THEN 400 WHEN repository IS NULL THEN -300 ELSE -2000 END + CASE WHEN branch = 'main' THEN 200 WHEN branch IS NULL THEN -100 ELSE -700 END)) AS score,
         CASE WHEN repository = repo OR branch = 'main' THEN 'scoped_label' ELSE 'label' END AS method FROM m JOIN n ON n.kind = m.kind AND n.key = m.key
  UNION ALL
  SELECT input_id, 'm1', id, least(9900, least(10000, 9700 + CASE WHEN repository = repo THEN 400 WHEN repository IS NULL THEN -300 ELSE -2000 END + CASE WHEN branch = 'main' THEN 200 WHEN branch IS NULL THEN -100 ELSE -700 END)), 'external_id' FROM m JOIN n ON n.kind = m.kind AND n.ck = m.k
)"""


@register(f"{_LINKS} SELECT * FROM c")
def link_candidates(spark, sf_dir):
    inputs, mentions = customer_mentions(spark, sf_dir, every=False)
    return linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98)).candidates(mentions, inputs)


@register(
    f"""{_LINKS}, a AS (SELECT input_id, unnest(['m0', 'm1', 'm2']) AS local_id FROM m),
d AS (SELECT a.input_id, a.local_id, c.entity_id, c.score, c.method FROM a LEFT JOIN c USING (input_id, local_id))
SELECT input_id, local_id, CASE WHEN score >= 8000 THEN entity_id END AS entity_id, CASE WHEN score >= 8000 THEN score ELSE 0 END AS score, CASE WHEN score >= 8000 THEN method ELSE 'unresolved' END AS method FROM d"""
)
def link_decisions(spark, sf_dir):
    inputs, mentions = customer_mentions(spark, sf_dir, every=False)
    catalog = linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98))
    return catalog.link(mentions, inputs, linking.LinkPolicy(create_unmatched=False))[0].drop("ordinal")


@register(
    f"""{_LINKS}, k AS (SELECT DISTINCT input_id, max(score) AS score FROM c WHERE local_id = 'm0' GROUP BY input_id)
SELECT input_id, 'node_upserted' AS event_type, 9000 AS confidence, 1 AS n FROM m
UNION ALL SELECT m.input_id, 'fact_recorded', CASE WHEN k.score >= 8000 THEN least(9000, k.score) ELSE 9000 END, 1 FROM m LEFT JOIN k USING (input_id)
UNION ALL SELECT m.input_id, 'node_upserted', 10000, 1 FROM m LEFT JOIN k USING (input_id) WHERE coalesce(k.score, 0) < 8000"""
)
def extraction_events(spark, sf_dir):
    """Kinds of planned events by input; a node's confidence is that of its mention."""
    inputs, mentions = customer_mentions(spark, sf_dir, every=False)
    catalog = linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98))
    done = linking.plan(CustomerProvider(mentions), inputs, catalog)
    score = done.links.filter("method = 'created'").select("input_id", F.col("entity_id").alias("node_id"), "score")
    rows = done.events.withColumn("node_id", F.col("payload.node.id")).join(score, ["input_id", "node_id"], "left")
    return rows.select("input_id", "event_type", F.coalesce("payload.fact.confidence", "score").alias("confidence"), F.lit(1).alias("n"))


_PLANNED = f"""{_ALL_LINKS}, k AS (SELECT input_id, max(score) AS score FROM c WHERE local_id = 'm0' GROUP BY input_id),
p AS (
  SELECT m.*, coalesce(k.score, 0) AS score, 'stranger ' || m.k AS stranger, {sql.stable_hash("c_name || ' wrote'")} AS print
  FROM m LEFT JOIN k USING (input_id) JOIN customer ON c_custkey = m.k
), i AS (
  SELECT *, 'auto:person:' || {sql.stable_hash("repo", "'main'", "'person'", "stranger")} AS new_id,
         CASE WHEN score >= 8000 THEN 'customer:' || k ELSE 'auto:' || kind || ':' || {sql.stable_hash("repo", "'main'", "kind", "key")} END AS known_id FROM p
), f AS (SELECT *, 'fact:auto:' || {sql.stable_hash("'customers'", "'crm'", "print", "'r0'", "known_id", "'knows'", "new_id")} AS fact_id FROM i)"""


def planned(spark: SparkSession, sf_dir: str) -> linking.Plan:
    inputs, mentions = customer_mentions(spark, sf_dir)
    return linking.plan(CustomerProvider(mentions), inputs, linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98)))


@register(
    f"""{_PLANNED} SELECT new_id AS id, 'event:auto:node:' || {sql.stable_hash("'customers'", "'crm'", "print", "new_id")} AS event_id, 'Stranger ' || k AS label, repo AS repository, 'main' AS branch,
'alias.0=S' || k || ',extracted_by=customers,extraction_source=crm' AS attributes FROM i"""
)
def extraction_nodes(spark, sf_dir):
    """The nodes made for strangers, with their ids, attributes and event ids."""
    n = F.col("payload.node")
    shown = F.array_join(F.sort_array(F.transform(F.map_entries(n["attributes"]), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    rows = planned(spark, sf_dir).events.filter("event_type = 'node_upserted' AND payload.node.label LIKE 'Stranger %'")
    return rows.select(n["id"].alias("id"), F.col("id").alias("event_id"), n["label"].alias("label"), n["repository"].alias("repository"), n["branch"].alias("branch"), shown.alias("attributes"))


@register(
    f"""{_PLANNED} SELECT fact_id AS id, 'event:auto:fact:' || {sql.stable_hash("'customers'", "'crm'", "print", "fact_id")} AS event_id, known_id AS source, 'knows' AS relation, new_id AS target,
CASE WHEN score >= 8000 THEN least(9000, score) ELSE 9000 END AS confidence, {T97} AS valid_from, 'source:crm,extraction_provider:customers' AS evidence FROM f"""
)
def extraction_facts(spark, sf_dir):
    """The facts of the plan, with their ids, ends, confidence, evidence and event ids."""
    f = F.col("payload.fact")
    shown = F.array_join(F.transform(f["evidence"], lambda e: F.concat_ws(":", e["kind"], e["source"])), ",")
    rows = planned(spark, sf_dir).events.filter("event_type = 'fact_recorded'")
    return rows.select(f["id"].alias("id"), F.col("id").alias("event_id"), f["source"].alias("source"), f["relation"].alias("relation"), f["target"].alias("target"), f["confidence"].alias("confidence"), f["valid_from"].alias("valid_from"), shown.alias("evidence"))


@register(
    f"""{_PLANNED} SELECT new_id AS id, 'alias.0=S' || k || ',alias.3=N' || c_nationkey || ',extracted_by=customers,extraction_source=crm' AS attributes FROM i JOIN customer ON c_custkey = k"""
)
def extraction_merged_nodes(spark, sf_dir):
    """Each stranger named twice, the second time with one alias more: one node, which has both."""
    inputs, mentions = customer_mentions(spark, sf_dir)
    nations = table(spark, sf_dir, "customer").select(F.concat(F.lit("doc:"), F.col("c_custkey").cast("string")).alias("input_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"))
    again = mentions.filter("local_id = 'm2'").join(nations, "input_id").withColumns({"ordinal": F.lit(3), "local_id": F.lit("m3"), "aliases": F.concat("aliases", F.array("nation"))}).drop("nation")
    done = linking.plan(CustomerProvider(mentions.unionByName(again)), inputs, linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98)))
    n = F.col("payload.node")
    shown = F.array_join(F.sort_array(F.transform(F.map_entries(n["attributes"]), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return done.events.filter("event_type = 'node_upserted' AND payload.node.label LIKE 'Stranger %'").select(n["id"].alias("id"), shown.alias("attributes"))


@register(
    f"""{sql.BASE}, {sql.nodes(T98)}, m AS (SELECT 'doc:' || c_custkey AS input_id, CASE WHEN c_acctbal < 0 THEN 'newcomer:' ELSE 'customer:' END || c_custkey AS given FROM customer)
SELECT input_id, 'm0' AS local_id, given AS entity_id, 10000 AS score, CASE WHEN nodes.id IS NULL THEN 'created' ELSE 'stable_id' END AS method FROM m LEFT JOIN nodes ON nodes.id = given"""
)
def stable_id_decisions(spark, sf_dir):
    """Mentions that bring an id: the known entity, or a new one of this id, whatever else would match."""
    inputs, mentions = customer_mentions(spark, sf_dir)
    owing = table(spark, sf_dir, "customer").select(F.concat(F.lit("doc:"), F.col("c_custkey").cast("string")).alias("input_id"), F.when(F.col("c_acctbal") < 0, "newcomer:").otherwise("customer:").alias("of"), "c_custkey")
    given = mentions.filter("local_id = 'm0'").join(owing, "input_id").withColumn("stable_id", F.concat("of", F.col("c_custkey").cast("string"))).drop("of", "c_custkey")
    return linking.Catalog.from_view(memory(spark, sf_dir).view(T98, T98)).link(given, inputs)[0].drop("ordinal")


@register(
    """WITH c AS (SELECT *, 'doc:' || c_custkey AS input_id, c_nationkey = 0 OR 2 * c_nationkey > octet_length(encode(c_name || ' wrote')) AS bad_span FROM customer)
SELECT input_id, 'mention id twice' AS error FROM c WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT input_id, 'unknown endpoint' FROM c WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT input_id, 'mention span' FROM c WHERE bad_span UNION ALL SELECT input_id, 'relation span' FROM c WHERE bad_span UNION ALL SELECT input_id, 'relation valid_until' FROM c WHERE floor(c_acctbal) <= 0"""
)
def extraction_problems(spark, sf_dir):
    """Output whose spans, ends and times follow from the customers, most of them wrong in some way."""
    inputs, mentions = customer_mentions(spark, sf_dir)
    c = table(spark, sf_dir, "customer").withColumn("input_id", F.concat(F.lit("doc:"), F.col("c_custkey").cast("string")))
    span = F.struct(F.col("c_nationkey").cast("int").alias("start"), (2 * F.col("c_nationkey")).cast("int").alias("end"))
    first = mentions.filter("local_id = 'm0'").drop("span").join(c.select("input_id", span.alias("span")), "input_id")
    twice = mentions.filter("local_id = 'm1'").join(c.filter("c_mktsegment = 'MACHINERY'").select("input_id"), "input_id", "left_semi")
    all_ = mentions.filter("local_id <> 'm0'").unionByName(first).unionByName(twice)
    relations = c.join(inputs.select("input_id", "occurred_at"), "input_id").select(
        "input_id", F.lit("r0").alias("local_id"), F.lit("m0").alias("source"), F.when(F.col("c_mktsegment") == "BUILDING", "nobody").otherwise("m2").alias("target"), span.alias("span"),
        F.lit(None).cast("long").alias("valid_from"), (F.col("occurred_at") + F.floor("c_acctbal").cast("long")).alias("valid_until"),
    )
    return linking.output_problems(inputs, all_, relations)


@register(f"{_PLANNED} SELECT count(*) + count(*) FILTER (score < 8000) AS node_event_count, count(*) AS fact_event_count FROM p")
def extraction_counts(spark, sf_dir):
    return planned(spark, sf_dir).counts()


# ---- evaluation


def benchmark_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each benchmark item asks with its first words for itself, in groups of ten items."""
    b = table(spark, sf_dir, "benchmark")
    group = F.expr("item_id div 10").cast("string")
    documents = b.select(group.alias("group_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    words = F.slice(F.split("text", " "), 1, 4)
    cases = b.select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), group.alias("group_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.array_join(words, " ").alias("query"),
        F.array(F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("relevant_ids"),
    )
    return documents, cases


_LITERAL = """WITH d AS (SELECT (item_id // 10)::VARCHAR AS group_id, 'b' || item_id AS id, item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda t: strlen(t) > 1)) AS t FROM benchmark),
q AS (SELECT 'q' || item_id AS case_id, (item_id // 10)::VARCHAR AS group_id, item_id, list_distinct(list_filter(string_split_regex(lower(array_to_string(string_split(text, ' ')[1:4], ' ')), '[^\\p{L}\\p{N}\\p{M}]+'), lambda t: strlen(t) > 1)) AS w FROM benchmark),
s AS (SELECT case_id, q.item_id, id, len(list_intersect(t, w)) AS score FROM q JOIN d USING (group_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS place FROM s)"""


@register(f"{_LITERAL} SELECT case_id, string_agg(id, ',' ORDER BY place) AS ranked_ids FROM r WHERE place <= 5 GROUP BY case_id")
def literal_ranking(spark, sf_dir):
    documents, cases = benchmark_cases(spark, sf_dir)
    return evaluation.literal_predictions(cases, documents, 5).select("case_id", joined("ranked_ids"))


@register(
    f"""{_LITERAL}, hit AS (SELECT case_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, min(place) FILTER (id = 'b' || item_id AND place <= 5) AS p FROM r GROUP BY case_id, item_id),
x AS (SELECT *, unnest([1, 5]) AS cutoff FROM hit)
SELECT category, cutoff, count(*) AS cases, round(avg((coalesce(p, 99) <= cutoff)::INT), 9) AS hit, round(avg((coalesce(p, 99) <= cutoff)::INT), 9) AS recall,
       round(avg(CASE WHEN coalesce(p, 99) <= cutoff THEN 1 / log2(p + 1) ELSE 0 END), 9) AS ndcg, round(avg(coalesce(1.0 / p, 0)), 9) AS mrr
FROM x GROUP BY GROUPING SETS ((cutoff), (category, cutoff))"""
)
def retrieval_metrics(spark, sf_dir):
    documents, cases = benchmark_cases(spark, sf_dir)
    predictions = materialize(evaluation.literal_predictions(cases, documents, 5), "predictions")
    metrics = evaluation.evaluate(cases, predictions, [1, 5])
    return metrics.select("category", "cutoff", "cases", *[F.round(c, 9).alias(c) for c in ("hit", "recall", "ndcg", "mrr")])


def session_rows(spark, sf_dir):
    """Each conversation as a question about its one session."""
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    none = F.lit(None).cast("string")
    rows = c.groupBy("conv_id").agg(F.array(turns).alias("haystack_sessions"))
    return rows.select(
        F.col("conv_id").cast("string").alias("question_id"), F.lit("single").alias("question_type"), none.alias("question"), F.array(F.lit("s0")).alias("haystack_session_ids"), "haystack_sessions",
        F.array(F.lit("s0")).alias("answer_session_ids"),
    )


@register(
    """SELECT conv_id::VARCHAR AS group_id, conv_id || '::session::s0' AS id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"""
)
def dialog_documents(spark, sf_dir):
    return evaluation.sessions(session_rows(spark, sf_dir))[0]


@register(
    """SELECT conv_id::VARCHAR AS group_id, conv_id || '::session::s0' AS id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"""
)
def split_array_documents(spark, sf_dir):
    """The same by way of JSON array files, each read in several blocks."""
    path = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    json_arrays.write_array(session_rows(spark, sf_dir), path)
    return evaluation.read_sessions(spark, path, block_bytes=1 << 16)[0]


@register(
    """SELECT conv_id || '::qa::0' AS id, conv_id::VARCHAR AS group_id, 'locomo_2' AS category, text AS query,
       conv_id || '::dialog::D1:0' || CASE WHEN EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = 1) THEN ',' || conv_id || '::dialog::D1:1' ELSE '' END AS relevant
FROM conversations c WHERE turn = 0"""
)
def dialog_cases(spark, sf_dir):
    """Each conversation as a dialog that is asked for its first two turns, and for one it doesn't have."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.struct(F.col("role").alias("speaker"), F.concat(F.lit("D1:"), F.col("turn").cast("string")).alias("dia_id"), "text").alias("t"))
    rows = c.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"])).alias("turns"), F.min_by("text", "turn").alias("first"))
    asked = F.array(F.struct(F.col("first").alias("question"), F.lit(2).cast("bigint").alias("category"), F.array(F.lit("D1:0; D1:1"), F.lit("D9:9")).alias("evidence")))
    rows = rows.select(F.col("conv_id").cast("string").alias("sample_id"), asked.alias("qa"), F.create_map(F.lit("session_1"), F.col("turns"), F.lit("session_1_date_time"), F.lit("noon")).alias("conversation"))
    return evaluation.dialogs(rows)[1].select("id", "group_id", "category", "query", F.array_join("relevant_ids", ",").alias("relevant"))


@register(
    """SELECT 'q' || item_id AS id, CASE item_id % 10 WHEN 0 THEN 'id twice' WHEN 1 THEN 'empty query' WHEN 2 THEN 'no relevant ids' WHEN 3 THEN 'unknown group' ELSE 'relevant id outside its group' END AS error
FROM benchmark WHERE item_id % 10 <= 4 UNION ALL SELECT 'q' || item_id, 'relevant id outside its group' FROM benchmark WHERE item_id % 10 = 3"""
)
def prepared_problems(spark, sf_dir):
    """What is wrong in cases that were damaged by their number."""
    documents, cases = benchmark_cases(spark, sf_dir)
    k = F.substring("id", 2, 20).cast("long") % 10
    cases = cases.withColumns(
        {
            "query": F.when(k == 1, " ").otherwise(F.col("query")),
            "relevant_ids": F.when(k == 2, F.array().cast("array<string>")).when(k == 4, F.array(F.lit("nothing"))).otherwise(F.col("relevant_ids")),
            "group_id": F.when(k == 3, "elsewhere").otherwise(F.col("group_id")),
        }
    )
    return evaluation.prepared_problems(documents, cases.unionByName(cases.filter(k == 0)))


@register(
    """WITH a AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice) AS n FROM lineitem)
SELECT 'DuplicateEvent' AS error, id AS detail FROM a GROUP BY id HAVING count(*) > 1"""
)
def restore_problems(spark, sf_dir):
    """A log whose ids repeat (order lines) in one stream, otherwise contiguous."""
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), "l_extendedprice", "l_quantity")
    placed = with_positions(l, ["id", "l_extendedprice", "l_quantity"], "global_position")
    return event_log.position_problems(placed.select("id", "global_position", F.lit("lines").alias("stream_id"), F.col("global_position").alias("stream_version")))


