"""Graph projection and bounded traversal over edge tables.

Traversals carry a request id, so many requests share each hop; a hop is one join of the frontier
with the edges and one anti-join against what was reached, its result written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import MissingEntity
from palimpsest.operators.view import View
from palimpsest.sources.storage import materialize


def confidence_level(bps: Column) -> Column:
    return F.when(bps >= 9500, "exact").when(bps >= 8000, "high").when(bps >= 5000, "medium").otherwise("low")


def project_graph(view: View, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """vertices (id, label, kind, attributes) and edges (source, target, kind, provenance, attributes)."""
    if check:
        ids = view.nodes.select("id")
        for end in ("source", "target"):
            missing = view.facts.select(F.col(end).alias("id")).join(ids, "id", "left_anti").limit(1).collect()
            if missing:
                raise MissingEntity(missing[0]["id"])
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    optional = lambda key, c: F.when(c.isNotNull(), F.create_map(F.lit(key), c)).otherwise(F.create_map().cast("map<string,string>"))
    prefixed = F.transform_keys(own, lambda k, _: F.concat(F.lit("memory."), k))
    vertices = view.nodes.select("id", "label", "kind", F.map_concat(optional("memory.repository", F.col("repository")), optional("memory.branch", F.col("branch")), prefixed).alias("attributes"))
    first = F.get("evidence", 0)
    provenance = F.struct(first["source"].alias("source"), first["kind"].alias("kind"), confidence_level(F.col("confidence")).alias("confidence"), F.coalesce(first["locator"], F.col("id")).alias("detail"))
    listed = F.to_json(F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["source"], F.coalesce(e["locator"], F.lit("")))))
    always = F.create_map(
        F.lit("fact_id"), F.col("id"), F.lit("valid_from"), F.col("valid_from").cast("string"), F.lit("recorded_at"), F.col("recorded_at").cast("string"),
        F.lit("confidence_bps"), F.col("confidence").cast("string"), F.lit("evidence"), listed,
    )
    attributes = F.map_concat(always, optional("valid_until", F.col("valid_until").cast("string")), optional("supersedes", F.col("supersedes")))
    edges = view.facts.select("source", "target", F.col("relation").alias("kind"), provenance.alias("provenance"), attributes.alias("attributes"))
    return vertices, edges


def spread(roots: DataFrame, edges: DataFrame, max_depth: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """(request, entity, depth): least number of edges (source -> target) from a root of the request.

    roots: (request, entity). allowed: entities that may be reached (all, when None). Without
    max_depth it runs until nothing new is found."""
    steps = edges.select(F.col("source").alias("entity"), F.col("target").alias("next")).distinct()
    frontier = materialize(roots.select("request", "entity").distinct().withColumn("depth", F.lit(0)), "frontier")
    reached, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(steps, "entity").select("request", F.col("next").alias("entity")).distinct()
        if allowed is not None:
            found = found.join(allowed.select("entity"), "entity", "left_semi")
        fresh = found.join(reached.select("request", "entity"), ["request", "entity"], "left_anti")
        frontier = materialize(fresh.select("request", "entity", F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def both_ways(facts: DataFrame) -> DataFrame:
    ends = facts.select("source", "target")
    return ends.unionByName(ends.select(F.col("target").alias("source"), F.col("source").alias("target")))


def bfs_out(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """roots: (entity). (entity, depth) along outgoing edges."""
    return spread(roots.select(F.lit(0).alias("request"), "entity"), edges, max_depth).select("entity", "depth")


def strong_components(edges: DataFrame) -> DataFrame:
    """(entity, component): nodes that reach each other along edges have one component, named by one of them.

    Forward-backward with trimming. Nodes without an edge into or out of their part are components of
    their own and are peeled off. Each part that is left has a pivot, the node with the most pairs of an
    edge in and an edge out; what the pivot reaches and what reaches it meet in its component. The rest
    falls into three parts (reached, reaching, neither), between which no component lies, so edges between
    parts go. All parts advance together; a turn is a few joins on the node, whatever their number."""
    steps = edges.select("source", "target").filter("source <> target").distinct()
    nodes = edges.select(F.col("source").alias("entity")).union(edges.select("target")).distinct()
    inner = materialize(steps.withColumn("part", F.lit(0).cast("long")), "part-edges")
    settled = None
    while True:
        inner = trimmed(inner)
        if inner.isEmpty():
            break
        ends = inner.select("part", F.col("source").alias("entity"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(
            inner.select("part", F.col("target").alias("entity"), F.lit(0).alias("out"), F.lit(1).alias("in_"))
        )
        members = materialize(ends.groupBy("part", "entity").agg((F.sum("out") * F.sum("in_")).alias("pairs")), "members")
        pivots = members.groupBy("part").agg(F.max(F.struct("pairs", "entity"))["entity"].alias("entity"))
        pivots = materialize(pivots.select(F.col("part").alias("request"), "entity"), "pivots")
        ahead = spread(pivots, inner, None).select(F.col("request").alias("part"), "entity", F.lit(True).alias("ahead"))
        back = spread(pivots, inner.select(F.col("target").alias("source"), F.col("source").alias("target")), None)
        back = back.select(F.col("request").alias("part"), "entity", F.lit(True).alias("back"))
        told = members.select("part", "entity").join(ahead, ["part", "entity"], "left").join(back, ["part", "entity"], "left")
        told = materialize(told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ahead", "back")}), "parted")
        found = told.filter("ahead AND back").join(pivots.select(F.col("request").alias("part"), F.col("entity").alias("component")), "part").select("entity", "component")
        settled = found if settled is None else settled.unionByName(found)
        # Parts whose names should ever be equal only share their turns: no edge leads from one to the other.
        rest = told.filter("NOT (ahead AND back)").select("entity", F.xxhash64("part", "ahead", "back").alias("now"))
        of = lambda end: rest.select(F.col("entity").alias(end), F.col("now").alias(f"{end}_part"))
        moved = inner.select("source", "target").join(of("source"), "source").join(of("target"), "target").filter("source_part = target_part")
        inner = materialize(moved.select("source", "target", F.col("source_part").alias("part")), "part-edges")
    if settled is None:
        return materialize(nodes.withColumn("component", F.col("entity")), "strong-components")
    return materialize(nodes.join(settled, "entity", "left").withColumn("component", F.coalesce("component", "entity")), "strong-components")


def trimmed(inner: DataFrame) -> DataFrame:
    """inner (part, source, target) without edges that lie on no cycle because an end has no edge on its other side."""
    n = inner.count()
    while n:
        heads, tails = inner.select("part", F.col("target").alias("source")).distinct(), inner.select("part", F.col("source").alias("target")).distinct()
        kept = materialize(inner.join(heads, ["part", "source"], "left_semi").join(tails, ["part", "target"], "left_semi").select("part", "source", "target"), "part-edges")
        left = kept.count()
        if left == n:
            return inner
        inner, n = kept, left
    return inner


def reachable_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(entity, n): how many other entities each root reaches along outgoing edges (0 if it isn't in them).

    Only what some root reaches is looked at. Strongly connected components are contracted, as their members
    reach the same; the closure runs over the acyclic rest from the roots' components, so that its rows are
    pairs of components (a root's and a reached one), and a component counts with its size."""
    starts = materialize(roots.select("entity").distinct(), "roots")
    touched = spread(starts.select(F.lit(0).alias("request"), "entity"), edges, None).select("entity")
    near = materialize(edges.select("source", "target").distinct().join(touched.withColumnRenamed("entity", "source"), "source", "left_semi"), "near-edges")
    parts = strong_components(near)
    of = lambda end: parts.select(F.col("entity").alias(end), F.col("component").alias(f"{end}_component"))
    contracted = near.join(of("source"), "source").join(of("target"), "target").filter("source_component <> target_component")
    contracted = materialize(contracted.select(F.col("source_component").alias("source"), F.col("target_component").alias("target")).distinct(), "contracted")
    known = materialize(starts.join(parts, "entity", "left"), "root-components")
    firsts = known.filter("component IS NOT NULL").select(F.col("component").alias("request"), F.col("component").alias("entity")).distinct()
    sizes = parts.groupBy(F.col("component").alias("entity")).agg(F.count(F.lit(1)).alias("size"))
    reach = spread(firsts, contracted, None).join(sizes, "entity").groupBy(F.col("request").alias("component")).agg(F.sum("size").alias("n"))
    return known.join(reach, "component", "left").select("entity", F.coalesce(F.col("n") - 1, F.lit(0).cast("long")).alias("n"))


def orphans(view: View) -> DataFrame:
    """Visible nodes without any active fact."""
    ends = view.facts.select(F.col("source").alias("id")).union(view.facts.select("target"))
    return view.nodes.join(ends, "id", "left_anti")
