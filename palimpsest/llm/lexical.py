"""Ranked lexical search: the best documents for each item by an integer form of BM25, over postings in
buckets of terms.

1. One pass over the texts gives the postings (bucket, term, row, doc_id, n, tf), written once, dealt by
   bucket and sorted by term, so that a reader of few terms skips most files' row groups by their
   statistics. With `terms` only their postings are made. Common terms fill several files of a bucket.
2. Item terms are joined to postings by term, each match is scored in integers, scores are summed by
   item and document, and a window keeps the first k of each item.
3. Not every match has to be summed. Terms get an upper bound (weight times the greatest impact of their
   postings). The sums over an item's rarest terms give a lower bound of its k-th best score; terms of
   the least upper bounds, together below it, can't bring a document in by themselves. Only documents
   with one of the other terms are candidates; those that the rest can't lift to the k-th best drop out;
   what is left is scored in full. The result is the same as if all were summed.

Edge cases: a null text has no terms. Each row of docs is a document, also where rows are equal or share
a doc_id; one with a null doc_id counts and comes last among equals. Rows of items that share an item_id
are one item with the terms of all; a null item_id is left out. An item without terms, or without
matches, has no rows; an empty table of either kind gives an empty result. Equal scores rank by
ascending doc_id. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, pick

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 512
#: Up to so many item terms (some 60 bytes each), or candidates (40 bytes), are sent to every task.
MAX_BROADCAST = 300_000
#: An item's rarest terms are summed first, until they have so many postings.
SEED_POSTINGS = 4_000
POSTING = "term string, row bigint, doc_id bigint, n bigint, tf bigint"

#: Bytes of terms as they are, A to Z lower-cased, all others a space (of UTF-8, all bytes above 0x7F are in terms).
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _small(df: DataFrame, bound: int = MAX_BROADCAST) -> DataFrame:
    """df, marked for broadcast if it has no more rows than the bound."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, k: how often each term stands in an item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, counts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = Counter(terms_of(text or ""))
                at += [i] * len(found)
                terms += [t.decode("utf-8", "surrogatepass") for t in found]
                counts += found.values()
            ids = batch.column("item_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["item_id", "term", "k"])

    told = pick(items, "item_id", "text").filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return told.mapInArrow(cut, "item_id bigint, term string, k bigint").groupBy("item_id", "term").agg(F.sum("k").alias("k"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """(postings, N, L): the postings of docs, of the given terms (a table with a column term) or of all;
    the number of documents with a term; and their terms with repeats."""
    wanted = None
    if terms is not None:
        distinct = terms.select("term").distinct()
        found = distinct.limit(MAX_BROADCAST + 1).collect()
        if len(found) <= MAX_BROADCAST:
            wanted = docs.sparkSession.sparkContext.broadcast({r[0].encode("utf-8", "surrogatepass") for r in found})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "row", "doc_id", "n", "tf"]
        for batch in batches:
            at, found_terms, lengths, counts, documents, words = [], [], [], [], 0, 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = terms_of(text or "")
                if not own:
                    continue
                documents, words = documents + 1, words + len(own)
                found = Counter(own)
                keep = found if wanted is None else found.keys() & wanted.value
                at += [i] * len(keep)
                lengths += [len(own)] * len(keep)
                for t in keep:
                    found_terms.append(t.decode("utf-8", "surrogatepass"))
                    counts.append(found[t])
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_terms, pa.string()), batch.column("row").take(where), batch.column("doc_id").take(where), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], names
            )
            # What the batch has in all: documents and their terms.
            one = pa.array([0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), one, pc.cast(pa.nulls(1), pa.int64()), pa.array([words], pa.int64()), pa.array([documents], pa.int64())], names)

    told = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = told.mapInArrow(cut, POSTING)
    if terms is not None and wanted is None:
        made = made.join(distinct, "term", "left_semi").unionByName(made.filter("term IS NULL"))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int").alias("bucket")
    index = materialize(made.select(bucket, "*").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "row"), "postings")
    n, total = index.filter("bucket = -1").agg(F.sum("tf"), F.sum("n")).first()
    return index.filter("bucket >= 0"), n or 0, total or 0


def _top(rows: DataFrame, k: int, *order) -> DataFrame:
    """rows with rank, the first k of each item. Spark keeps k an item in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)


def search(index: DataFrame, n_documents: int, n_terms: int, wanted: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. wanted: item_terms()."""
    if not n_documents:
        return wanted.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    m = f"(75 + (25 * n * {n_documents}L) div {n_terms}L)"
    scored = index.select("term", "row", "doc_id", F.expr(f"(1000000000L * tf) div (1000 * tf + 12 * {m})").alias("impact"))
    by_term = scored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
    weight = F.floor(1000 * F.log((2.0 * n_documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    terms = wanted.join(by_term, "term").withColumn("weight", F.col("k") * weight).filter("weight > 0")
    terms = materialize(terms.withColumn("bound", F.col("weight") * F.col("most")).select("item_id", "term", "weight", "df", "bound"), "item-terms")
    # Windows of one item's terms.
    before = Window.partitionBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seeds = terms.withColumn("ahead", F.coalesce(F.sum("df").over(before.orderBy("df", "term")), F.lit(0))).filter(F.col("ahead") < SEED_POSTINGS)

    def sums(rows: DataFrame, some: DataFrame) -> DataFrame:
        """(item_id, row, doc_id, part) over the matches with some item terms."""
        met = rows.join(_small(some.select("item_id", "term", "weight")), "term")
        return met.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("part"))

    def kth_best(parts: DataFrame) -> DataFrame:
        return _top(parts.select("item_id", "part"), k, F.desc("part")).filter(F.col("rank") == k).select("item_id", F.col("part").alias("least"))

    least = materialize(kth_best(sums(scored, seeds)), "kth-best")
    ruled = terms.join(_small(least), "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    ruled = ruled.withColumn("essential", F.sum("bound").over(upto.orderBy("bound", "term")) >= F.col("least"))
    ruled = materialize(ruled, "essential-terms")
    rest = ruled.groupBy("item_id").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))), F.lit(0)).alias("rest"), F.first("least").alias("least"))
    parts = materialize(sums(scored, ruled.filter("essential")), "parts")
    better = materialize(kth_best(parts).select("item_id", F.col("least").alias("better")), "kth-best")
    limits = rest.join(_small(better), "item_id", "left").select("item_id", "rest", F.greatest("least", F.coalesce("better", "least")).alias("least"))
    candidates = materialize(parts.join(_small(limits), "item_id").filter(F.col("part") + F.col("rest") >= F.col("least")).drop("rest", "least"), "candidates")
    others = _small(ruled.filter("NOT essential").select("item_id", "term", "weight"))
    pairs = candidates.select("item_id", "row")
    met = scored.select("term", "row", "impact").join(_small(pairs), "row").join(others, ["item_id", "term"])
    more = met.groupBy("item_id", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("more"))
    full = candidates.join(more, ["item_id", "row"], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0))).filter("score > 0")
    best = _top(full, k, F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Each item's k best documents."""
    wanted = materialize(item_terms(items), "wanted")
    return search(*postings(docs, wanted), wanted, k)
