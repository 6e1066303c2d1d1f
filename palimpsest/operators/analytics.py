"""Belief revision, drift, reasoning gaps and consolidation over a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue
from palimpsest.functions.text import lower_ascii
from palimpsest.operators.graph import bfs_out, orphans, reachable_counts
from palimpsest.operators.view import Clock, Projection, View
from palimpsest.schema import ACTION_KINDS, GAP_KINDS
from palimpsest.sources.ordered import carried, in_order
from palimpsest.sources.storage import materialize

#: Relations that support their target.
SUPPORTING = ("supports", "supported_by", "caused_by")


def _ordinal(c: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), c)


# ---- belief revision


def contradictions(view: View, hypothesis: dict) -> DataFrame:
    """(fact, strength_bps, reason) of active facts that contradict the hypothesis (keys source,
    relation, target, confidence and, where it replaces a fact, supersedes)."""
    h = {k: F.lit(hypothesis.get(k)) for k in ("source", "relation", "target", "supersedes")}
    competing = (F.col("source") == h["source"]) & (F.col("relation") == h["relation"]) & (F.col("target") != h["target"])
    pair = (F.col("source") == h["source"]) & (F.col("target") == h["target"]) | (F.col("source") == h["target"]) & (F.col("target") == h["source"])
    explicit = (lower_ascii(F.col("relation")) == "contradicts") & pair
    corrected = F.coalesce(F.col("id") == h["supersedes"], F.lit(False))
    # The wording of the reasons.
    reason = F.when(explicit, "explicit contradicts relation").when(corrected, "hypothesis explicitly supersedes this fact").otherwise("same source and relation assert a different target")
    return view.facts.filter(competing | explicit | corrected).select(
        F.col("id").alias("fact"), F.least(F.col("confidence"), F.lit(int(hypothesis["confidence"]))).alias("strength_bps"), reason.alias("reason"), "target"
    )


def belief_revision(projection: Projection, hypothesis: dict, clock: Clock, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contradictions, cascade (entity, depth, revised_confidence_bps) and invalidated decisions (entity)."""
    view = projection.view(clock.valid_at, clock.known_at)
    found = contradictions(view, hypothesis)
    effects = bfs_out(view.facts, found.select(F.col("target").alias("entity")).distinct(), max_depth)
    revised = F.lit(10_000) - F.floor(F.lit(int(hypothesis["confidence"])) / (F.col("depth") + 2))
    cascade = effects.withColumn("revised_confidence_bps", revised.cast("int"))
    decisions = view.nodes.filter(lower_ascii(F.col("kind")) == "decision").select(F.col("id").alias("entity"))
    return found.drop("target"), cascade, cascade.select("entity").join(decisions, "entity", "left_semi")


# ---- drift


def drift(projection: Projection, known_at: int, source: str | None = None, relation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots and summary of every (source, relation), or of the given one: all known facts in
    the order (recorded_at, id), whatever their validity. A pair may hold all facts: each is compared
    with the one before it within a range of the order, and ranges hand on their last fact."""
    rows = projection.known_facts(known_at)
    rows = rows if source is None else rows.filter(F.col("source") == source)
    rows = rows if relation is None else rows.filter(F.col("relation") == relation)
    pair, order = ["source", "relation"], ["recorded_at", "id"]
    ordered = in_order(rows.select(*pair, "id", "target", "recorded_at", "confidence", "supersedes"), pair, order)
    rows = carried(ordered, pair, F.struct("id", "target", "confidence")).withColumnRenamed("_carried", "p")
    corrected = F.coalesce(F.col("supersedes") == F.col("p.id"), F.lit(False)) | (F.col("target") != F.col("p.target"))
    change = (
        F.when(F.col("p").isNull(), "initial")
        .when(corrected, "corrected")
        .when(F.col("confidence") > F.col("p.confidence"), "reinforced")
        .when(F.col("confidence") < F.col("p.confidence"), "weakened")
        .otherwise("refined")
    )
    snapshots = rows.select("source", "relation", F.col("id").alias("fact"), "target", "recorded_at", F.col("confidence").alias("confidence_bps"), change.alias("change"))
    steps, corrections = F.col("n") - 1, F.col("correction_count")
    penalty = F.least(F.lit(10_000), F.floor((corrections * 6000 + (steps - corrections) * 1000) / steps))
    stability = F.when(steps <= 0, F.lit(10_000)).otherwise(F.lit(10_000) - penalty).cast("int")
    summary = (
        snapshots.groupBy("source", "relation")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("change") == "corrected").alias("correction_count"))
        .withColumn("stability_bps", stability)
        .withColumn("likely_to_change", (corrections >= 2) | (F.col("stability_bps") < 6000))
    )
    return snapshots, summary


# ---- reasoning gaps

GAP = ("entity", "fact", "kind", "severity_bps")


def support_counts(view: View) -> DataFrame:
    """(entity, supports): supporting facts, not sources, of each target."""
    rows = view.facts.filter(lower_ascii(F.col("relation")).isin(*SUPPORTING))
    return rows.groupBy(F.col("target").alias("entity")).agg(F.count(F.lit(1)).alias("supports"))


def _gap(rows: DataFrame, entity: str, fact: Column, kind: str, severity: Column) -> DataFrame:
    return rows.select(F.col(entity).alias("entity"), fact.cast("string").alias("fact"), F.lit(kind).alias("kind"), severity.cast("int").alias("severity_bps"))


def node_gaps(view: View, minimum_supports: int) -> DataFrame:
    nodes = view.nodes.select(F.col("id").alias("entity"), lower_ascii(F.col("kind")).alias("node_kind")).filter("node_kind IN ('decision', 'inference')")
    rows = nodes.join(support_counts(view), "entity", "left").withColumn("supports", F.coalesce("supports", F.lit(0)))
    bare = rows.filter("node_kind = 'decision' AND supports = 0")
    thin = rows.filter((F.col("node_kind") == "inference") & (F.col("supports") < minimum_supports))
    share = F.least(F.lit(10_000), F.floor((F.lit(minimum_supports) - F.col("supports")) * 10_000 / minimum_supports))
    return _gap(bare, "entity", F.lit(None), GAP_KINDS[0], F.lit(10_000)).unionByName(_gap(thin, "entity", F.lit(None), GAP_KINDS[1], share))


def fact_gaps(view: View, clock: Clock, low_confidence_bps: int, stale_after_micros: int) -> DataFrame:
    weak = view.facts.filter(F.col("confidence") < low_confidence_bps)
    age = F.lit(clock.known_at).cast("decimal(38,0)") - F.col("recorded_at")
    old = view.facts.withColumn("age", age).filter(F.col("age") >= stale_after_micros)
    severity = F.lit(10_000) if stale_after_micros == 0 else F.least(F.greatest(F.floor(F.expr(f"(age * 5000) div {stale_after_micros}")), F.lit(1000)), F.lit(10_000))
    return _gap(weak, "target", F.col("id"), GAP_KINDS[2], F.lit(10_000) - F.col("confidence")).unionByName(_gap(old, "target", F.col("id"), GAP_KINDS[4], severity))


def unstable_gaps(projection: Projection, known_at: int, revision_count: int) -> DataFrame:
    groups = projection.known_facts(known_at).groupBy("source", "relation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("supersedes").isNotNull()).alias("s"), F.max_by("id", F.struct("recorded_at", "id")).alias("last")
    )
    rows = groups.filter((F.col("n") >= revision_count) & (F.col("s") + 1 >= revision_count))
    return _gap(rows, "source", F.col("last"), GAP_KINDS[3], F.least(F.lit(10_000), F.col("n") * 2000))


def all_gaps(projection: Projection, clock: Clock, minimum_supports: int, low_confidence_bps: int, unstable_revision_count: int, stale_after_micros: int) -> tuple[View, DataFrame]:
    if minimum_supports < 1 or not 0 <= low_confidence_bps <= 10_000 or unstable_revision_count < 2 or stale_after_micros < 0:
        raise InvalidValue("reasoning_gap: thresholds must be in their ranges")
    view = projection.view(clock.valid_at, clock.known_at).kept()
    found = node_gaps(view, minimum_supports).unionByName(fact_gaps(view, clock, low_confidence_bps, stale_after_micros))
    return view, found.unionByName(unstable_gaps(projection, clock.known_at, unstable_revision_count))


def reasoning_gaps(
    projection: Projection, clock: Clock, minimum_supports: int, low_confidence_bps: int, unstable_revision_count: int, stale_after_micros: int, max_results: int
) -> tuple[DataFrame, DataFrame]:
    """The first max_results gaps, and one row (health_bps, analyzed_entities, analyzed_facts,
    total_gaps) by the count before the cut. Reach is counted only for entities of gaps that may be among them."""
    if max_results < 1:
        raise InvalidValue("reasoning_gap: max_results must be positive")
    view, gaps = all_gaps(projection, clock, minimum_supports, low_confidence_bps, unstable_revision_count, stale_after_micros)
    gaps = materialize(gaps, "gaps")
    found = contenders(gaps, max_results)
    known = view.nodes.select(F.col("id").alias("entity"))
    roots = found.select("entity").distinct().join(known, "entity", "left_semi")
    reach = reachable_counts(view.facts, roots).select("entity", F.col("n").alias("downstream_entities"))
    rows = found.join(reach, "entity", "left").withColumn("downstream_entities", F.coalesce("downstream_entities", F.lit(0)))
    kind = _ordinal(F.col("kind"), GAP_KINDS)
    top = rows.orderBy(F.desc("severity_bps"), F.desc("downstream_entities"), "entity", kind, F.asc_nulls_first("fact")).limit(max_results)
    return top, gap_health(view, gaps)


def contenders(gaps: DataFrame, max_results: int) -> DataFrame:
    """The gaps that may be among the first max_results: severity comes first in their order, so none below
    the severity of the max_results-th gap is. Severities are 10,001 values at most; they are counted, not sorted."""
    counts = gaps.groupBy("severity_bps").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("severity_bps")).rowsBetween(Window.unboundedPreceding, -1)
    least = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).filter(F.col("above") < max_results).agg(F.min("severity_bps")).first()[0]
    return gaps.filter(F.col("severity_bps") >= (least or 0))


def gap_health(view: View, gaps: DataFrame) -> DataFrame:
    counts = (
        gaps.agg(F.count(F.lit(1)).alias("total_gaps"))
        .crossJoin(view.nodes.agg(F.count(F.lit(1)).alias("analyzed_entities")))
        .crossJoin(view.facts.agg(F.count(F.lit(1)).alias("analyzed_facts")))
    )
    share = F.least(F.lit(10_000), F.floor(F.col("total_gaps") * 10_000 / F.col("analyzed_entities")))
    health = F.when(F.col("analyzed_entities") == 0, F.lit(10_000)).otherwise(F.lit(10_000) - share)
    return counts.select(health.cast("int").alias("health_bps"), "analyzed_entities", "analyzed_facts", "total_gaps")


# ---- consolidation

ACTION = ("kind", "keep", "affected_facts", "affected_entities")


def duplicate_actions(view: View) -> DataFrame:
    """Active facts of one (source, relation, target): the strongest, then newest, then least id stays. Only the
    facts of groups that have several are listed."""
    key = ["source", "relation", "target"]
    several = view.facts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), (-F.col("recorded_at")).alias("r"), "id")))
    groups = view.facts.join(several, key, "left_semi").groupBy(*key).agg(F.transform(ranked, lambda x: x["id"]).alias("ids"))
    return groups.select(F.lit(ACTION_KINDS[0]).alias("kind"), F.get("ids", 0).alias("keep"), F.col("ids").alias("affected_facts"), F.array("source", "target").alias("affected_entities"))


def orphan_actions(view: View) -> DataFrame:
    none = F.array().cast("array<string>")
    return orphans(view).select(F.lit(ACTION_KINDS[1]).alias("kind"), F.lit(None).cast("string").alias("keep"), none.alias("affected_facts"), F.array("id").alias("affected_entities"))


def revision_chain_actions(projection: Projection, known_at: int) -> DataFrame:
    """(source, relation) with three or more superseding facts: the last by (recorded_at, id) stays. Only the facts
    of such chains are listed."""
    known, key = projection.known_facts(known_at), ["source", "relation"]
    long = known.groupBy(*key).agg(F.count_if(F.col("supersedes").isNotNull()).alias("s")).filter("s >= 3").select(*key)
    ranked = F.sort_array(F.collect_list(F.struct("recorded_at", "id")))
    groups = known.join(long, key, "left_semi").groupBy(*key).agg(F.transform(ranked, lambda x: x["id"]).alias("ids"))
    return groups.select(F.lit(ACTION_KINDS[2]).alias("kind"), F.element_at("ids", -1).alias("keep"), F.col("ids").alias("affected_facts"), F.array("source").alias("affected_entities"))


def consolidation_plan(projection: Projection, clock: Clock, max_actions: int) -> tuple[DataFrame, DataFrame]:
    """The first max_actions actions, and one row (projected_savings, source_position) of those."""
    if max_actions < 1:
        raise InvalidValue("consolidation.max_actions must be greater than zero")
    view = projection.view(clock.valid_at, clock.known_at).kept()
    actions = duplicate_actions(view).unionByName(orphan_actions(view)).unionByName(revision_chain_actions(projection, clock.known_at))
    top = actions.orderBy(_ordinal(F.col("kind"), ACTION_KINDS), "affected_entities", "affected_facts").limit(max_actions)
    saved = F.when(F.col("kind") == ACTION_KINDS[1], F.lit(0)).otherwise(F.size("affected_facts") - 1)
    summary = top.agg(F.coalesce(F.sum(saved), F.lit(0)).alias("projected_savings")).withColumn("source_position", F.lit(projection.last_position).cast("long"))
    return top, summary
