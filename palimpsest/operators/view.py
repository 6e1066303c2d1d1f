"""Bitemporal reads: what is visible at (valid_at, known_at)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.ordered import carried, in_order
from palimpsest.sources.storage import materialize, with_positions


@dataclass(frozen=True)
class Clock:
    valid_at: int
    known_at: int


@dataclass(frozen=True)
class View:
    """Lazy result of a bitemporal read."""

    nodes: DataFrame
    facts: DataFrame

    def kept(self) -> View:
        """The same view, written once: several reports or hops read it again."""
        return View(materialize(self.nodes, "view-nodes"), materialize(self.facts, "view-facts"))


@dataclass(frozen=True)
class Projection:
    """The projected state as tables of schema NODE_REVISION, STORED_FACT, SUPERSESSION, RETRACTION."""

    node_revisions: DataFrame
    facts: DataFrame
    supersessions: DataFrame
    retractions: DataFrame
    last_position: int | None = None

    def visible_nodes(self, known_at: int) -> DataFrame:
        """Of each entity the revision with the greatest (recorded_at, position) known by known_at."""
        rows = self.node_revisions.filter(F.col("recorded_at") <= known_at)
        kept = [c for c in rows.columns if c != "id"]
        latest = F.max_by(F.struct(*kept), F.struct("recorded_at", "position")).alias("r")
        return rows.groupBy("id").agg(latest).select("id", "r.*")

    def active_facts(self, clock: Clock, facts: DataFrame | None = None) -> DataFrame:
        """Known, valid, not superseded and not retracted facts. The cheap tests filter the scan; what is
        superseded or retracted is one set of ids, whose anti-join sees only rows that the clock lets through. It is
        merged: the set grows with the facts, and its compressed size would have it broadcast."""
        rows = (self.facts if facts is None else facts).filter(is_current(clock.valid_at, clock.known_at))
        applies = (F.col("recorded_at") <= clock.known_at) & (F.col("valid_from") <= clock.valid_at)
        replaced = self.supersessions.filter(applies).select(F.col("prior").alias("id"))
        ended = self.retractions.filter((F.col("recorded_at") <= clock.known_at) & (F.col("valid_until") <= clock.valid_at)).select(F.col("fact_id").alias("id"))
        return rows.join(replaced.unionByName(ended).hint("merge"), "id", "left_anti")

    def view(self, valid_at: int, known_at: int) -> View:
        """Visible nodes, and active facts between visible nodes."""
        nodes = self.visible_nodes(known_at)
        ids = nodes.select("id")
        facts = self.active_facts(Clock(valid_at, known_at))
        for end in ("source", "target"):
            facts = facts.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return View(nodes, facts)

    def kept(self) -> Projection:
        """The same state, written once: reads of it don't compute what it was made from again."""
        tables = zip(("node_revisions", "facts", "supersessions", "retractions"), (self.node_revisions, self.facts, self.supersessions, self.retractions), strict=True)
        return Projection(*(materialize(df, name.replace("_", "-")) for name, df in tables), self.last_position)

    def known_facts(self, known_at: int) -> DataFrame:
        return self.facts.filter(F.col("recorded_at") <= known_at)

    @property
    def superseded_by(self) -> DataFrame:
        return self.supersessions.select("prior", "replacement")

    def incidence(self, facts: DataFrame | None = None) -> DataFrame:
        """entity, fact: both ends of each fact, a self-loop once."""
        rows = self.facts if facts is None else facts
        return rows.select(F.col("source").alias("entity"), F.col("id").alias("fact")).unionByName(
            rows.filter("source <> target").select(F.col("target").alias("entity"), F.col("id").alias("fact"))
        )

    def equals(self, other: Projection) -> bool:
        """Same logical content, whatever the order of rows."""
        pairs = zip(self._tables(), other._tables(), strict=True)
        return self.last_position == other.last_position and all(_same(a, b) for a, b in pairs)

    def _tables(self) -> list[DataFrame]:
        return [_comparable(t) for t in (self.node_revisions, self.facts, self.supersessions, self.retractions)]


def _comparable(df: DataFrame) -> DataFrame:
    """Maps can't be compared by set operations; their sorted entries can."""
    return df.select(*[F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in sorted(df.dtypes)])


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def is_current(valid_at: int | Column, known_at: int | Column) -> Column:
    """Half-open validity, seen from a clock."""
    until = F.col("valid_until")
    return (F.col("recorded_at") <= known_at) & (F.col("valid_from") <= valid_at) & (until.isNull() | (until > valid_at))


def visible_as_of(node_revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each row of requests (request, entity, known_at, and no column of a revision) the revision of its entity
    that was visible then: the one with the greatest (recorded_at, position) known by known_at, nulls where there
    was none.

    One sorted pass for all clocks, instead of a view for each: requests and revisions are one table in the order of
    (entity, time), in which a request comes behind the revisions of its instant, and the last revision is carried
    forward. The order is cut into ranges, so an entity may have any number of revisions and requests."""
    kept = [c for c in node_revisions.columns if c != "id"]
    revision = F.struct(*kept)
    told = node_revisions.select(F.col("id").alias("entity"), F.col("recorded_at").alias("_at"), F.lit(0).alias("_asks"), F.col("position").alias("_order"), revision.alias("_revision"))
    none = F.lit(None).cast(told.schema["_revision"].dataType)
    # The hash only keeps apart the requests of one instant, so that they may be dealt over ranges.
    asked = requests.select("entity", F.col("known_at").alias("_at"), F.lit(1).alias("_asks"), F.xxhash64("request").alias("_order"), none.alias("_revision"), F.struct("request", "known_at").alias("_request"))
    both = told.withColumn("_request", F.lit(None).cast(asked.schema["_request"].dataType)).unionByName(asked)
    ordered = in_order(both, ["entity"], ["_at", "_asks", "_order"])
    rows = carried(ordered, ["entity"], F.col("_revision")).filter("_asks = 1")
    return rows.select("_request.request", "entity", "_request.known_at", "_carried.*")


MAX_CLOCKS = 10_000  # clocks that are broadcast at once


def bitemporal_matrix(projection: Projection, clocks: DataFrame) -> DataFrame:
    """Active facts for many clocks (valid_at, known_at, and a name) at once; clocks beyond MAX_CLOCKS are taken in blocks
    of so many, one after the other."""
    n = clocks.count()
    if n <= MAX_CLOCKS:
        return _at_clocks(projection, clocks)
    placed = with_positions(clocks, ["valid_at", "known_at"], "_clock")
    block = lambda at: placed.filter(F.col("_clock").between(at, at + MAX_CLOCKS - 1)).drop("_clock")
    return reduce(DataFrame.unionByName, [_at_clocks(projection, block(at)) for at in range(0, n, MAX_CLOCKS)])


def _at_clocks(projection: Projection, clocks: DataFrame) -> DataFrame:
    rows = projection.facts.join(F.broadcast(clocks), is_current(F.col("valid_at"), F.col("known_at")))
    s = projection.supersessions.select(F.col("prior").alias("id"), F.col("recorded_at").alias("s_known"), F.col("valid_from").alias("s_from"))
    r = projection.retractions.select(F.col("fact_id").alias("id"), F.col("recorded_at").alias("r_known"), F.col("valid_until").alias("r_until"))
    rows = rows.join(s, "id", "left").join(r, "id", "left")
    hidden = ((F.col("s_known") <= F.col("known_at")) & (F.col("s_from") <= F.col("valid_at"))) | ((F.col("r_known") <= F.col("known_at")) & (F.col("r_until") <= F.col("valid_at")))
    return rows.filter(~F.coalesce(hidden, F.lit(False))).drop("s_known", "s_from", "r_known", "r_until")
