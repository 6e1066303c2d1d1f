"""Replay: from the event log to the projection tables, set by set.

The sequential fold of an event log reports its first error. Here every rule is a query that gives
the events which break it, as rows (global_position, priority, error, detail); the first row by
(global_position, priority) is what a fold would stop at, as everything before it is sound.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import BY_KIND, ConflictingFact, InvalidValue, MemoryError_
from palimpsest.functions.text import is_bad_optional, is_bad_text
from palimpsest.operators.view import Projection
from palimpsest.schema import CERTAIN
from palimpsest.sources.storage import tasks_for


@dataclass(frozen=True)
class Cursor:
    """Where a replay stands: the last global position, and the last version of each stream as a
    table (stream_id, stream_version)."""

    global_position: int | None = None
    stream_versions: DataFrame | None = None


@dataclass(frozen=True)
class Snapshot:
    cursor: Cursor
    projection: Projection


@dataclass(frozen=True)
class Replay:
    projection: Projection
    cursor: Cursor
    violations: DataFrame = field(repr=False)


def _broken(rows: DataFrame, condition: Column, priority: int, error: str, detail: Column) -> DataFrame:
    return rows.filter(F.coalesce(condition, F.lit(False))).select(
        "global_position", F.lit(priority).alias("priority"), F.lit(error).alias("error"), detail.cast("string").alias("detail")
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_violations(events: DataFrame, cursor: Cursor = Cursor()) -> DataFrame:
    """Duplicate ids within the call, gaps in the global order, gaps in a stream's versions.

    A position is sound when the one before it exists, a version when its stream has the one before it
    at an earlier position, and has it once (counts by key, no windows: one stream may hold all rows). Counts
    name the keys that are broken, and events are joined with these alone."""
    tasks = tasks_for(events)
    e = events.select("id", "stream_id", "stream_version", "global_position")
    first = 0 if cursor.global_position is None else cursor.global_position + 1
    own, ahead = F.count_if("_own"), F.count_if(~F.col("_own"))
    told = lambda is_own, *keys: e.select(*keys, F.lit(is_own).alias("_own"), F.col("global_position").alias("_at"))
    ids = e.repartition(tasks, "id").groupBy("id").agg(F.min("global_position").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "first")
    repeated = e.join(ids, "id").filter("global_position > first")
    places = told(True, "global_position").unionByName(told(False, (F.col("global_position") + 1).alias("global_position")))
    places = places.repartition(tasks, "global_position").groupBy("global_position").agg(own.alias("n"), ahead.alias("ahead"))
    places = places.filter((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("ahead") == 0) & (F.col("global_position") != first)))
    lone = places.filter((F.col("ahead") == 0) & (F.col("global_position") != first))
    alone = lone.select("global_position", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    versions = told(True, "stream_id", "stream_version").unionByName(told(False, "stream_id", (F.col("stream_version") + 1).alias("stream_version")))
    versions = versions.repartition(tasks, "stream_id", "stream_version").groupBy("stream_id", "stream_version")
    versions = versions.agg(own.alias("n"), F.min(F.when(F.col("_own"), F.col("_at"))).alias("first"), F.min(F.when(~F.col("_own"), F.col("_at"))).alias("_before"))
    starts = F.col("stream_version") == 0
    if cursor.stream_versions is not None:
        versions = versions.join(cursor.stream_versions.select("stream_id", F.col("stream_version").alias("_last")), "stream_id", "left")
        starts = F.col("stream_version") == F.coalesce("_last", F.lit(-1)) + 1
    loose = ~F.coalesce(F.col("_before") < F.col("first"), F.lit(False)) & ~starts
    versions = versions.filter((F.col("n") > 1) | ((F.col("n") > 0) & loose)).select(F.col("stream_id").alias("_stream"), F.col("stream_version").alias("_version"), "first", "_before", starts.alias("_starts"))
    odd = e.join(versions, F.col("stream_id").eqNullSafe(F.col("_stream")) & F.col("stream_version").eqNullSafe(F.col("_version")))
    follows = F.coalesce(F.col("_before") < F.col("global_position"), F.lit(False)) | F.col("_starts")
    return _all(
        [
            _broken(repeated, F.lit(True), 1, "DuplicateEvent", F.col("id")),
            _broken(alone, F.lit(True), 2, "InvalidReplay", F.concat(F.lit("global position after "), (F.col("global_position") - 1).cast("string"))),
            _broken(places, F.col("n") > 1, 2, "InvalidReplay", F.lit("global position twice")),
            _broken(odd, ~follows, 3, "InvalidReplay", F.concat(F.lit("stream version "), F.col("stream_version").cast("string"), F.lit(" follows no other"))),
            _broken(odd, F.col("global_position") > F.col("first"), 3, "InvalidReplay", F.concat(F.lit("stream version "), F.col("stream_version").cast("string"), F.lit(" twice"))),
        ]
    )


def bad_evidence(evidence: Column) -> Column:
    """Some item breaks the text rules."""
    return F.exists(evidence, lambda x: is_bad_text(x["kind"]) | is_bad_text(x["source"]) | is_bad_optional(x["locator"]) | is_bad_optional(x["digest"]))


def node_problem(n: Column) -> Column:
    """Null for a sound node, else what is wrong."""
    keys = F.map_keys(F.coalesce(n["attributes"], F.create_map().cast("map<string,string>")))
    return (
        F.when(is_bad_text(n["id"]), "node.id")
        .when(is_bad_text(n["kind"]), "node.kind")
        .when(n["label"].isNull() | (n["label"] == ""), "node.label")
        .when(is_bad_optional(n["repository"]), "node.repository")
        .when(is_bad_optional(n["branch"]), "node.branch")
        .when(F.exists(keys, is_bad_text), "node.attributes")
    )


def fact_problem(f: Column) -> Column:
    """Null for a sound fact, else what is wrong."""
    return (
        F.when(is_bad_text(f["id"]) | is_bad_text(f["source"]) | is_bad_text(f["target"]), "fact.id")
        .when(is_bad_text(f["relation"]), "fact.relation")
        .when(f["observed_at"] > f["recorded_at"], "fact.observed_at")
        .when(f["valid_until"] <= f["valid_from"], "fact.valid_until")
        .when((f["confidence"] < 0) | (f["confidence"] > CERTAIN), "fact.confidence")
        .when(F.coalesce(F.size(f["evidence"]), F.lit(0)) < 1, "fact.evidence")
        .when(bad_evidence(f["evidence"]), "fact.evidence")
    )


def payload_violations(events: DataFrame, known: Projection | None = None) -> DataFrame:
    """Envelope and payload rules, and references to entities and facts that come too late or never.
    `known` is the state before the events (a resumed snapshot)."""
    e, tasks = events, tasks_for(events) + (tasks_for(known.facts) if known is not None else 0)
    kind, n, f = F.col("payload.type"), F.col("payload.node"), F.col("payload.fact")
    is_node, is_fact, is_end = kind == "node_upserted", kind == "fact_recorded", kind == "fact_retracted"
    envelope = (f["recorded_at"] != F.col("recorded_at")) | (f["agent_id"] != F.col("agent_id")) | (f["session_id"] != F.col("session_id"))
    # What an event breaks by itself, in one pass.
    rule = lambda condition, priority, error, detail: F.when(condition, F.struct(F.lit(priority).alias("priority"), F.lit(error).alias("error"), detail.cast("string").alias("detail")))
    bad_node, bad_fact = F.when(is_node, node_problem(n)), F.when(is_fact, fact_problem(f))
    rules = [
        rule(F.col("event_type") != kind, 4, "InvalidReplay", F.col("event_type")),
        rule(bad_node.isNotNull(), 5, "InvalidValue", bad_node),
        rule(is_fact & envelope, 5, "InvalidReplay", F.lit("fact envelope")),
        rule(bad_fact.isNotNull(), 6, "InvalidValue", bad_fact),
    ]
    alone = e.select("global_position", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("global_position", "r.*")
    seen = e.filter(is_node).select(n["id"].alias("entity"), F.col("global_position").alias("since"))
    facts = e.filter(is_fact).select("global_position", f["source"].alias("source"), f["target"].alias("target"), f["id"].alias("fact"), f["supersedes"].alias("prior"), f["valid_from"].alias("from"))
    gone = e.filter(is_end)
    recorded = facts.select("fact", F.col("global_position").alias("since"), "from")
    superseding = facts.filter("prior IS NOT NULL").select("prior", "global_position")
    replaced = superseding
    if known is not None:
        seen = seen.unionByName(known.node_revisions.select(F.col("id").alias("entity"), F.lit(-1).cast("long").alias("since")))
        recorded = recorded.unionByName(known.facts.select(F.col("id").alias("fact"), F.lit(-1).cast("long").alias("since"), F.col("valid_from").alias("from")))
        replaced = replaced.unionByName(known.supersessions.select("prior", F.lit(-1).cast("long").alias("global_position")))
    # Joins with tables that grow with the log are merged: by the compressed size of its columns Spark would
    # broadcast a million ids through the driver. Many facts may share an end: entities whose first reference comes too soon are found first, one row for
    # each entity, and facts are joined with these alone.
    seen = seen.groupBy("entity").agg(F.min("since").alias("since"))
    ends = facts.select("global_position", F.explode(F.array(F.struct(F.lit(7).alias("priority"), F.col("source").alias("entity")), F.struct(F.lit(8).alias("priority"), F.col("target").alias("entity")))).alias("end")).select("global_position", "end.*")
    asked = ends.groupBy("entity").agg(F.min("global_position").alias("asked"))
    early = asked.repartition(tasks, "entity").join(seen.repartition(tasks, "entity").hint("merge"), "entity", "left").filter("since IS NULL OR since >= asked").select(F.col("entity").alias("_entity"), "since")
    late = F.col("since").isNull() | (F.col("since") >= F.col("global_position"))
    missing = ends.join(early, F.col("entity").eqNullSafe(F.col("_entity"))).filter(late)
    # References to facts: a fact's own record, what it replaces, what a retraction ends.
    first_fact = recorded.repartition(tasks, "fact").groupBy("fact").agg(F.min("since").alias("since"), F.min_by("from", "since").alias("from"))
    blank = [F.lit(None).cast("long").alias("until"), F.lit(False).alias("none"), F.lit(False).alias("bad")]
    evidence = F.col("payload.evidence")
    told = [(F.coalesce(F.size(evidence), F.lit(0)) < 1).alias("none"), F.coalesce(bad_evidence(evidence), F.lit(False)).alias("bad")]
    references = (
        facts.select("fact", F.lit("own").alias("role"), "global_position", *blank)
        .unionByName(superseding.select(F.col("prior").alias("fact"), F.lit("prior").alias("role"), "global_position", *blank))
        .unionByName(gone.select(F.col("payload.fact_id").alias("fact"), F.lit("gone").alias("role"), "global_position", F.col("payload.valid_until").alias("until"), *told))
    )
    found = references.repartition(tasks, "fact").join(first_fact.hint("merge"), "fact", "left")
    of = lambda role: F.col("role") == role
    rules = [
        rule(of("own") & (F.col("since") < F.col("global_position")), 9, "ConflictingFact", F.col("fact")),
        rule(of("prior") & late, 10, "MissingFact", F.col("fact")),
        rule(of("gone") & late, 7, "MissingFact", F.col("fact")),
        rule(of("gone") & (F.col("until") <= F.col("from")), 8, "InvalidValue", F.lit("retraction.valid_until")),
        rule(of("gone") & F.col("none"), 9, "InvalidValue", F.lit("retraction.evidence")),
        rule(of("gone") & F.col("bad"), 10, "InvalidValue", F.lit("retraction.evidence")),
    ]
    found = found.select("global_position", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("global_position", "r.*")
    several = replaced.repartition(tasks, "prior").groupBy("prior").agg(F.min("global_position").alias("since"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("prior", "since")
    return _all(
        [
            alone,
            missing.select("global_position", "priority", F.lit("MissingEntity").alias("error"), F.col("entity").alias("detail")),
            found,
            _broken(superseding.join(several, "prior"), F.col("since") < F.col("global_position"), 11, "ConflictingFact", F.col("prior")),
        ]
    )


def violations(events: DataFrame, cursor: Cursor = Cursor(), known: Projection | None = None) -> DataFrame:
    return order_violations(events, cursor).unionByName(payload_violations(events, known))


def raise_first(found: DataFrame) -> None:
    first = found.orderBy("global_position", "priority").limit(1).collect()
    if first:
        row = first[0]
        text = f"at {row['global_position']}: {row['detail']}"
        known = BY_KIND.get(row["error"], MemoryError_)
        raise (known if known.__init__ is MemoryError_.__init__ else MemoryError_)(text)


def last_retractions(rows: DataFrame) -> DataFrame:
    """rows (fact_id, valid_until, recorded_at, position): of each fact the last one alone, before any clock."""
    return rows.groupBy("fact_id").agg(F.max_by(F.struct("valid_until", "recorded_at"), "position").alias("r")).select("fact_id", "r.*")


def _tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = F.col("global_position").alias("position")
    kind = F.col("payload.type")
    nodes = events.filter(kind == "node_upserted").select("payload.node.*", "recorded_at", at)
    facts = events.filter(kind == "fact_recorded").select("payload.fact.*", at)
    gone = events.filter(kind == "fact_retracted").select(F.col("payload.fact_id").alias("fact_id"), F.col("payload.valid_until").alias("valid_until"), "recorded_at", at)
    return nodes, facts, gone


def supersessions_of(facts: DataFrame) -> DataFrame:
    return facts.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("prior"), F.col("id").alias("replacement"), "valid_from", "recorded_at")


def replay(events: DataFrame, strict: bool = True) -> Replay:
    """The projection of a whole log. strict runs the checks now and raises the first error; else
    the checks stay a lazy table."""
    return resume(None, events, strict)


def resume(snapshot: Snapshot | None, tail: DataFrame, strict: bool = True) -> Replay:
    """Go on from a snapshot with the events after it. Ids are compared within the tail alone."""
    before = snapshot.projection if snapshot else None
    cursor = snapshot.cursor if snapshot else Cursor()
    found = violations(tail, cursor, before)
    if strict:
        raise_first(found)
    nodes, facts, gone = _tables(tail)
    supersessions = supersessions_of(facts)
    retractions = last_retractions(gone)
    streams = tail.groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"))
    if before is not None:
        nodes, facts = before.node_revisions.unionByName(nodes), before.facts.unionByName(facts)
        supersessions = before.supersessions.unionByName(supersessions)
        older = before.retractions.join(retractions.select("fact_id"), "fact_id", "left_anti")
        retractions = older.unionByName(retractions)
        if cursor.stream_versions is not None:
            streams = streams.unionByName(cursor.stream_versions).groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"))
    last = tail.agg(F.max("global_position")).first()[0]
    last = cursor.global_position if last is None else last
    return Replay(Projection(nodes, facts, supersessions, retractions, last), Cursor(last, streams), found)


def from_parts(nodes: DataFrame, facts: DataFrame, known_at: int, source_position: int | None = None) -> Projection:
    """Bulk build: every node becomes a revision of known_at; the order of facts is free.

    Raises on repeated ids, on facts recorded after known_at, on missing ends or priors and on a
    prior with two replacements."""
    checks = [
        (nodes.groupBy("id").count().filter("count > 1").select("id"), InvalidValue, "node id twice"),
        (nodes.select(node_problem(F.struct(*nodes.columns)).alias("id")).filter("id IS NOT NULL"), InvalidValue, "node"),
        (facts.select(fact_problem(F.struct(*facts.columns)).alias("id")).filter("id IS NOT NULL"), InvalidValue, "fact"),
        (facts.filter(F.col("recorded_at") > known_at).select("id"), InvalidValue, "fact recorded after known_at"),
        (facts.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").select("source"), BY_KIND["MissingEntity"], "source"),
        (facts.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("target"), BY_KIND["MissingEntity"], "target"),
        (facts.groupBy("id").count().filter("count > 1").select("id"), ConflictingFact, "fact id twice"),
        (facts.filter("supersedes IS NOT NULL").join(facts.select(F.col("id").alias("supersedes")), "supersedes", "left_anti").select("supersedes"), BY_KIND["MissingFact"], "prior"),
        (facts.filter("supersedes IS NOT NULL").groupBy("supersedes").count().filter("count > 1").select("supersedes"), ConflictingFact, "prior superseded twice"),
    ]
    for rows, error, text in checks:
        first = rows.limit(1).collect()
        if first:
            raise error(f"{text}: {first[0][0]}")
    zero = F.lit(0).cast("long")
    revisions = nodes.withColumns({"recorded_at": F.lit(known_at).cast("long"), "position": zero})
    none = facts.limit(0).select(F.col("id").alias("fact_id"), F.col("valid_from").alias("valid_until"), "recorded_at")
    return Projection(revisions, facts.withColumn("position", zero), supersessions_of(facts), none, source_position)


def state_problems(p: Projection) -> DataFrame:
    """What a loaded projection breaks: (error, detail). Empty for a sound one."""
    tasks = tasks_for(p.facts)
    dealt = lambda df, key: df.repartition(tasks, key)
    row = lambda df, error, detail: df.select(F.lit(error).alias("error"), F.col(detail).cast("string").alias("detail"))
    # Many facts may share an end, so ends are made distinct where they are read, before they are dealt.
    ends = p.facts.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    of_replacement = p.facts.select(F.col("id").alias("replacement"), F.col("supersedes"), F.col("valid_from").alias("vf"), F.col("recorded_at").alias("ra"))
    s = dealt(p.supersessions, "replacement").join(dealt(of_replacement, "replacement").hint("merge"), "replacement", "left")
    r = dealt(p.retractions, "fact_id").join(dealt(p.facts.select(F.col("id").alias("fact_id"), "valid_from"), "fact_id").hint("merge"), "fact_id", "left")
    agree = (F.col("supersedes") == F.col("prior")) & (F.col("vf") == F.col("valid_from")) & (F.col("ra") == F.col("recorded_at"))
    return _all(
        [
            row(dealt(p.facts.select("id"), "id").groupBy("id").count().filter("count > 1"), "ConflictingFact", "id"),
            row(dealt(ends, "id").join(dealt(p.node_revisions.select("id"), "id").hint("merge"), "id", "left_anti"), "MissingEntity", "id"),
            row(s.filter(~F.coalesce(agree, F.lit(False))), "ConflictingFact", "prior"),
            row(r.filter(F.col("valid_from").isNull() | (F.col("valid_until") <= F.col("valid_from"))), "InvalidValue", "fact_id"),
        ]
    )
