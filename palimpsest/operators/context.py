"""Context compilation: the neighbourhood of seeds, ranked and packed into a token budget.

Requests are batched: a request id travels through the traversal, so many requests share each hop
and each round of packing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import BudgetTooSmall, InvalidValue, MissingEntity
from palimpsest.functions.text import fact_tokens, node_tokens
from palimpsest.operators.graph import both_ways, project_graph, spread
from palimpsest.operators.retrieval import RetrievalProvider, RetrievalQuery, fuse_retrieval
from palimpsest.operators.view import Projection, View
from palimpsest.sources.storage import materialize, ship


@dataclass(frozen=True)
class ContextRequest:
    seeds: tuple[str, ...]
    valid_at: int
    known_at: int
    token_budget: int
    max_depth: int = 2
    relations: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()
    branches: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.seeds:
            raise InvalidValue("context.seeds must not be empty")
        if self.token_budget < 1:
            raise InvalidValue("context.token_budget must be positive")
        if self.max_depth < 0:
            raise InvalidValue("context.max_depth must not be negative")


@dataclass(frozen=True)
class Bundle:
    nodes: DataFrame
    facts: DataFrame
    vertices: DataFrame
    edges: DataFrame
    receipt: DataFrame
    retrieval: DataFrame | None = None


def in_scope(request: ContextRequest):
    """A null repository or branch is in no restricted scope."""
    ok = F.lit(True)
    for column, wanted in (("repository", request.repositories), ("branch", request.branches)):
        if wanted:
            ok = ok & F.coalesce(F.col(column).isin(*wanted), F.lit(False))
    return ok


@dataclass(frozen=True)
class Neighbourhood:
    reach: DataFrame  # request, entity, depth
    candidates: DataFrame  # request, id, distance, and the fact's columns
    excluded: DataFrame  # request, n


def neighbourhood(view: View, seeds: DataFrame, request: ContextRequest) -> Neighbourhood:
    """seeds: (request, entity). All nodes within max_depth over allowed facts through nodes in
    scope; facts with both ends among them; and how many facts lead from them out of scope."""
    nodes = view.nodes.select(F.col("id").alias("entity"), in_scope(request).alias("allowed"))
    facts = view.facts.filter(F.col("relation").isin(*request.relations)) if request.relations else view.facts
    facts = materialize(facts, "allowed-facts")
    allowed = materialize(nodes.filter("allowed").select("entity"), "allowed-nodes")
    reach = spread(seeds, both_ways(facts), request.max_depth, allowed)
    ends = reach.select("request", "entity", "depth")
    # From every reached end to its facts; a fact seen from both ends is a candidate.
    out = facts.join(ends.withColumnRenamed("entity", "source").withColumnRenamed("depth", "d1"), "source")
    both = out.join(ends.withColumnRenamed("entity", "target").withColumnRenamed("depth", "d2"), ["request", "target"])
    candidates = both.withColumn("distance", F.least("d1", "d2")).drop("d1", "d2")
    forbidden = nodes.filter("NOT allowed").select("entity")
    touching = []
    for near, far in (("source", "target"), ("target", "source")):
        seen = facts.join(ends.withColumnRenamed("entity", near), near).join(forbidden.withColumnRenamed("entity", far), far, "left_semi")
        touching.append(seen.select("request", "id"))
    excluded = touching[0].union(touching[1]).distinct().groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    return Neighbourhood(reach, candidates, excluded)


CHUNK = 1000  # facts of a request that are packed at once; Spark cuts ranks up to this number before it shuffles
SHARES = 64
TRIED = "request bigint, kind string, id string, tokens bigint"


def pack(candidates: DataFrame, tokens: DataFrame, seeds: DataFrame, budgets: DataFrame, bytes_per_token: int = 4) -> DataFrame:
    """Greedy packing for each request, rows (request, kind, id): kind `node` and `fact` for what is
    taken, `omitted` for each fact that did not fit, and `used` with the tokens as id; `required` alone,
    with their tokens, where the seeds don't fit.

    Facts come in the order (distance, confidence down, recorded_at down, id). A fact costs its own
    tokens and those of its ends not yet taken (a self-loop on a new node pays the node twice); one
    that does not fit is passed over and the next is tried. An end without a cost never fits.

    The chain is followed in rounds. What a fact costs now, it and the facts that pay for its ends will
    cost in any case; if that is beyond what is left, it is omitted. Of the others the first CHUNK
    are packed by one task, and what they leave decides on the rest. The first of a chunk fits (but
    for self-loops, which a chunk passes over), so rounds end with the budget; one or two is usual."""
    spark = candidates.sparkSession
    ship(spark)
    facts = materialize(candidates.withColumn("tokens", fact_tokens(bytes_per_token)).select("request", "id", "source", "target", "distance", "confidence", "recorded_at", "tokens"), "candidates")
    start = seeds.select("request", F.col("entity").alias("id")).distinct()
    spent = start.join(tokens, "id").groupBy("request").agg(F.sum("tokens").alias("spent"))
    state = materialize(budgets.join(spent, "request").select("request", "spent", (F.col("budget") - F.col("spent")).alias("left")), "budgets")
    open_ = state.filter("left >= 0")

    live = facts
    for end in ("source", "target"):
        live = live.join(tokens.select(F.col("id").alias(end), F.col("tokens").alias(f"{end}_cost")), end)
    left, taken, rounds = open_.select("request", "left"), start, []
    while True:
        live = materialize(_affordable(live, taken, left), "affordable")
        if live.isEmpty():
            break
        tried = materialize(_first(live).groupBy("request").applyInPandas(_try_in_order, TRIED), "tried")
        rounds.append(tried)
        left = tried.filter("kind = 'left'").select("request", F.col("tokens").alias("left"))
        taken = tried.filter("kind = 'node'").select("request", "id")
        live = live.drop("left").join(tried.filter("kind IN ('fact', 'passed')").select("request", "id"), ["request", "id"], "left_anti")

    tried = spark.createDataFrame([], TRIED)
    for rows in rounds:
        tried = tried.unionByName(rows)
    chosen = tried.filter("kind = 'fact'").select("request", "kind", "id", "tokens")
    omitted = facts.join(open_, "request", "left_semi").join(chosen, ["request", "id"], "left_anti").select("request", F.lit("omitted").alias("kind"), "id")
    nodes = start.join(open_, "request", "left_semi").union(tried.filter("kind = 'node'").select("request", "id")).select("request", F.lit("node").alias("kind"), "id")
    paid = open_.select("request", F.col("spent").alias("tokens")).union(chosen.select("request", "tokens")).groupBy("request").agg(F.sum("tokens").alias("tokens"))
    used = paid.select("request", F.lit("used").alias("kind"), F.col("tokens").cast("string").alias("id"))
    required = state.filter("left < 0").select("request", F.lit("required").alias("kind"), F.col("spent").cast("string").alias("id"))
    return chosen.drop("tokens").union(omitted).union(nodes).union(used).union(required)


def _affordable(live: DataFrame, taken: DataFrame, left: DataFrame) -> DataFrame:
    """Facts that may still fit; ends just taken are free."""
    for end in ("source", "target"):
        free = taken.select("request", F.col("id").alias(end), F.lit(True).alias("free"))
        live = live.join(free, ["request", end], "left").withColumn(f"{end}_cost", F.when(F.col("free"), F.lit(0)).otherwise(F.col(f"{end}_cost"))).drop("free")
    # A self-loop's node may be paid once by another fact.
    least = F.col("tokens") + F.col("source_cost") + F.when(F.col("source") == F.col("target"), F.lit(0)).otherwise(F.col("target_cost"))
    return live.join(left, "request").filter(least <= F.col("left"))


def _first(live: DataFrame) -> DataFrame:
    """The first CHUNK facts of each request. They are ranked in shares first, so that the last window
    of a request holds SHARES * CHUNK rows at most."""
    order = ["distance", F.desc("confidence"), F.desc("recorded_at"), "id"]
    rows = live.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    for keys in (["request", "share"], ["request"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= CHUNK)
    return rows.drop("share")


def _try_in_order(chunk: pd.DataFrame) -> pd.DataFrame:
    """Rows (request, kind, id, tokens): `fact` with what it cost, `passed`, `node` newly taken, and `left`."""
    request, left = int(chunk.request.iloc[0]), int(chunk.left.iloc[0])
    taken, out = set(), []
    for row in chunk.sort_values("place").itertuples(index=False):
        ends = ((row.source, row.source_cost), (row.target, row.target_cost))
        price = int(row.tokens + sum(cost for end, cost in ends if end not in taken))
        if price > left:
            out.append((request, "passed", row.id, 0))
            continue
        left -= price
        out += [(request, "node", end, 0) for end in dict.fromkeys(end for end, cost in ends if cost and end not in taken)]
        taken.update((row.source, row.target))
        out.append((request, "fact", row.id, price))
    return pd.DataFrame([*out, (request, "left", "", left)], columns=["request", "kind", "id", "tokens"])


def compile_many(projection: Projection, requests: list[ContextRequest], bytes_per_token: int = 4) -> tuple[View, Neighbourhood, DataFrame]:
    """Packing rows for requests that differ in seeds and budget alone (same clock, depth and scope)."""
    spark, first = projection.facts.sparkSession, requests[0]
    view = projection.view(first.valid_at, first.known_at)
    seeds = spark.createDataFrame([(n, s) for n, r in enumerate(requests) for s in sorted(set(r.seeds))], "request bigint, entity string")
    open_nodes = view.nodes.filter(in_scope(first)).select(F.col("id").alias("entity"))
    missing = seeds.join(open_nodes, "entity", "left_anti").orderBy("entity").limit(1).collect()
    if missing:
        raise MissingEntity(missing[0]["entity"])
    around = neighbourhood(view, seeds, first)
    tokens = view.nodes.select("id", node_tokens(bytes_per_token).alias("tokens"))
    budgets = spark.createDataFrame([(n, r.token_budget) for n, r in enumerate(requests)], "request bigint, budget bigint")
    return view, around, materialize(pack(around.candidates, tokens, seeds, budgets, bytes_per_token), "packed")


def compile_context(projection: Projection, request: ContextRequest, bytes_per_token: int = 4) -> Bundle:
    view, around, picked = compile_many(projection, [request], bytes_per_token)
    too_small = picked.filter("kind = 'required'").collect()
    if too_small:
        raise BudgetTooSmall(int(too_small[0]["id"]), request.token_budget)
    chosen = lambda kind: picked.filter(F.col("kind") == kind).select("id")
    nodes = view.nodes.join(chosen("node"), "id", "left_semi")
    facts = around.candidates.drop("request", "distance").join(chosen("fact"), "id", "left_semi")
    counts = picked.groupBy().pivot("kind", ["fact", "omitted", "node"]).agg(F.count(F.lit(1)))
    used = picked.filter("kind = 'used'").select(F.col("id").cast("long").alias("estimated_tokens"))
    excluded = around.excluded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("excluded_by_scope"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    receipt = counts.crossJoin(used).crossJoin(excluded).select(
        F.lit(request.valid_at).alias("valid_at"),
        F.lit(request.known_at).alias("known_at"),
        F.lit(projection.last_position).cast("long").alias("source_position"),
        F.lit("utf8_bytes").alias("estimator"),
        F.lit(request.token_budget).alias("token_budget"),
        "estimated_tokens",
        (zero("fact") + zero("omitted")).alias("examined_facts"),
        zero("node").alias("selected_nodes"),
        zero("fact").alias("selected_facts"),
        zero("omitted").alias("omitted_by_budget"),
        "excluded_by_scope",
    )
    vertices, edges = project_graph(View(nodes, facts), check=False)
    return Bundle(nodes, facts, vertices, edges, receipt)


def compile_with_retrieval(projection: Projection, request: ContextRequest, query: RetrievalQuery, providers: list[RetrievalProvider], bytes_per_token: int = 4) -> Bundle:
    """Seeds are the fused hits that are known at known_at (limit of them at most); the bundle keeps
    all fused hits. A hit out of scope fails the whole compile, as a seed out of scope does."""
    hits = materialize(fuse_retrieval(providers, query), "fused")
    known = projection.visible_nodes(request.known_at).select(F.col("id").alias("entity"))
    seeds = tuple(r["entity"] for r in hits.join(known, "entity", "left_semi").select("entity").collect())
    if not seeds:
        raise MissingEntity("no retrieved entity is known")
    scoped = ContextRequest(seeds, request.valid_at, request.known_at, request.token_budget, request.max_depth, request.relations, request.repositories, request.branches)
    bundle = compile_context(projection, scoped, bytes_per_token)
    return Bundle(bundle.nodes, bundle.facts, bundle.vertices, bundle.edges, bundle.receipt, hits)

