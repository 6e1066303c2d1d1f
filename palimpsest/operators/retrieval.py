"""Rank fusion of retrieval hits, and providers that make hits from tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue, RetrievalFailure
from palimpsest.functions.text import token_set
from palimpsest.schema import CHANNELS
from palimpsest.sources.storage import opened, shared_dir, ship

#: Reciprocal rank fusion in integers.
SCALE, RANK_CONSTANT = 1_000_000_000, 60
#: A provider's hits are ranked in so many shares first, of which each gives its best.
SHARES = 256


@dataclass(frozen=True)
class RetrievalQuery:
    text: str
    limit: int
    channels: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.text or self.text != self.text.strip():
            raise InvalidValue("retrieval.text must be non-empty without surrounding white space")
        if self.limit < 1:
            raise InvalidValue("retrieval.limit must be positive")
        if not set(self.channels) <= set(CHANNELS):
            raise InvalidValue(f"channels are {CHANNELS}")

    def include(self, channel: str) -> RetrievalQuery:
        return RetrievalQuery(self.text, self.limit, tuple(dict.fromkeys((*self.channels, channel))))


class RetrievalProvider(Protocol):
    """Gives hits (entity, channel, score); needs a unique name without outer white space."""

    name: str

    def retrieve(self, query: RetrievalQuery) -> DataFrame: ...


def channel_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CHANNELS)), c)


def fuse(hits: DataFrame, limit: int, channels: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(entity, fused_score, sources) from hits (provider, entity, channel, score), best first.

    `by` names request columns: many queries are then fused at once. A provider's hits of an entity
    count once, by its best; its first `limit` entities get ranks; each adds SCALE div (60 + rank). Hits
    are cut to the best `limit` of their partition before a provider's meet in one place."""
    if channels:
        hits = hits.filter(F.col("channel").isin(*channels))
    best_first = [F.desc("score"), "entity", channel_order(F.col("channel"))]
    order = F.struct((-F.col("score")).alias("down"), channel_order(F.col("channel")).alias("way"))
    best = hits.groupBy(*by, "provider", "entity").agg(F.min_by(F.struct("channel", "score"), order).alias("best")).select(*by, "provider", "entity", "best.*")
    ranked = Window.partitionBy(*by, "provider").orderBy(*best_first)
    some = Window.partitionBy(*by, "provider", "_share").orderBy(*best_first)
    rows = best.withColumn("_share", F.pmod(F.xxhash64("entity"), F.lit(SHARES)))
    rows = rows.withColumn("_n", F.row_number().over(some)).filter(F.col("_n") <= limit)
    rows = rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= limit)
    rows = rows.withColumn("contribution", F.expr(f"{SCALE} div ({RANK_CONSTANT} + rank)"))
    source = F.struct("provider", "channel", "rank", "score", "contribution")
    fused = rows.groupBy(*by, "entity").agg(F.sum("contribution").alias("fused_score"), F.sort_array(F.collect_list(source)).alias("sources"))
    if not by:
        return fused.orderBy(F.desc("fused_score"), "entity").limit(limit)
    place = Window.partitionBy(*by).orderBy(F.desc("fused_score"), "entity")
    return fused.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)


def collect_hits(providers: list[RetrievalProvider], query: RetrievalQuery) -> DataFrame:
    names = [p.name for p in providers]
    if any(not n or n != n.strip() for n in names) or len(set(names)) < len(names):
        raise InvalidValue("provider names must be unique, non-empty and without outer white space")
    out = None
    for provider in sorted(providers, key=lambda p: p.name):
        try:
            hits = provider.retrieve(query).select(F.lit(provider.name).alias("provider"), "entity", "channel", F.col("score").cast("long"))
        except Exception as error:
            raise RetrievalFailure(f"{provider.name}: {error}") from error
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise InvalidValue("no retrieval provider")
    return out


def fuse_retrieval(providers: list[RetrievalProvider], query: RetrievalQuery) -> DataFrame:
    return fuse(collect_hits(providers, query), query.limit, query.channels)


class LiteralProvider:
    """Shared tokens of the query and each text (entity, text)."""

    def __init__(self, texts: DataFrame, name: str = "literal"):
        self.texts, self.name = texts, name

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        score = F.size(F.array_intersect(token_set(F.col("text")), token_set(F.lit(query.text))))
        return self.texts.select("entity", F.lit("literal").alias("channel"), score.alias("score")).filter("score > 0")


class Bm25Provider:
    """Okapi BM25 over tokens, scores in millionths."""

    def __init__(self, texts: DataFrame, name: str = "lexical", k1: float = 1.2, b: float = 0.75):
        self.texts, self.name, self.k1, self.b = texts, name, k1, b

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        words = self.texts.select("entity", F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) > 1).alias("w"))
        sizes = words.select("entity", F.size("w").alias("n"), "w")
        totals = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
        asked = self.texts.sparkSession.range(1).select(F.explode(token_set(F.lit(query.text))).alias("term"))
        terms = sizes.select("entity", "n", F.explode("w").alias("term")).join(F.broadcast(asked), "term").groupBy("entity", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
        df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("n") / F.col("mean")))
        rows = terms.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
        scored = rows.groupBy("entity").agg(F.round(F.sum(idf * weight) * 1_000_000).cast("long").alias("score"))
        return scored.select("entity", F.lit("lexical").alias("channel"), "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries and vectors of a block whose products are in a task at once.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Products that differ by less than this may be equal scores of millionths.
CLOSE = 2e-6


def _directions(vectors: pd.Series, size: int) -> np.ndarray:
    """Rows of unit length; NaN for a vector that is null, holds a null or a NaN, is zero, or is of another size."""
    out = np.full((len(vectors), size), np.nan)
    for n, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[n] = np.asarray(v, np.float64)
    with np.errstate(all="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the k nearest of vectors (id, vector) for each of asked (query_id, asked): greatest
    cosine in millionths, equal scores by id.

    All pairs are compared, in blocks of queries by vectors that tasks multiply; the queries are read from the
    shared folder a block at a time. A task passes on what is not surely worse than k others that it has met; these
    pairs, with the vectors themselves, get the exact score and meet in windows."""
    spark = vectors.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    asked.select("query_id", "asked").write.parquet(path)
    size = spark.read.parquet(path).select(F.max(F.size("asked"))).first()[0] or 1

    def blocks() -> Iterator[pd.DataFrame]:
        store, name = opened(path)
        for batch in pyarrow.dataset.dataset(name, filesystem=store, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if batch.num_rows:
                yield batch.to_pandas()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}  # of each query the k greatest products so far
        for frame in batches:
            for at in range(0, len(frame), VECTOR_BLOCK):
                part = frame.iloc[at : at + VECTOR_BLOCK]
                own = _directions(part.vector, size)
                for n, queries in enumerate(blocks()):
                    products = _directions(queries.asked, size) @ own.T
                    odd = np.isnan(products)
                    known = np.concatenate([best.get(n, np.full((len(queries), k), -np.inf)), np.where(odd, -np.inf, products)], axis=1)
                    best[n] = np.partition(known, known.shape[1] - k, axis=1)[:, -k:]
                    q, v = np.nonzero(odd | (products >= best[n].min(axis=1, keepdims=True) - CLOSE))
                    yield pd.DataFrame({"query_id": queries.query_id.to_numpy()[q], "id": part.id.to_numpy()[v], "asked": queries.asked.to_numpy()[q], "vector": part.vector.to_numpy()[v]})

    types = dict(vectors.dtypes) | dict(asked.dtypes)
    found = vectors.select("id", "vector").mapInPandas(near, ", ".join(f"{c} {types[c]}" for c in ("query_id", "id", "asked", "vector")))
    scored = found.select("query_id", "id", F.round(cosine(F.col("asked"), F.col("vector")) * 1_000_000).cast("long").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k).drop("_n")


class CosineProvider:
    """Cosine of a query vector with vectors (entity, vector), scores in millionths."""

    def __init__(self, vectors: DataFrame, query_vector: list[float], name: str = "semantic"):
        self.vectors, self.query_vector, self.name = vectors, query_vector, name

    def retrieve(self, query: RetrievalQuery) -> DataFrame:
        asked = F.array(*map(F.lit, self.query_vector))
        score = F.round(cosine(F.col("vector"), asked) * 1_000_000).cast("long")
        return self.vectors.select("entity", F.lit("semantic").alias("channel"), score.alias("score"))
