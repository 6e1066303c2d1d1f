"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Texts are lower-cased and cut at white space and punctuation. A mask names the token positions
that count within a span; the others may hold anything. Every window of every test item and of
every training text is hashed under each mask, the hashes are joined, and around each hit the two
texts are laid along each other: tokens that agree score 1, others -`MISMATCH`, and the best
stretch counts. A document is contaminated by an item when the best stretch has `min_match`
agreeing tokens, or all but a fifth of a shorter item.

The training side is not shuffled by window: its windows stream through a hash join against the
benchmark's, as long as those are few enough to broadcast (checked, `MAX_BROADCAST_SEEDS`);
beyond, Spark joins them by shuffle. Windows, seeds and hits are rows of numbers; each distinct hit
meets the tokens of its text and its item once.

Edge cases: null or empty texts on either side match nothing. Items shorter than every mask are
found word for word, by the hash of the whole item. Repeated rows and items of equal text are
reported under their own ids. A null doc_id or item_id is reported as null. Empty tables give an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ROW_KEY, materialize, with_row_key, without

#: 1 counts, 0 is ignored.
MASKS = ("1101101", "11010011", "1110111")
MISMATCH = 2
#: What stands between tokens.
PUNCTUATION = r"[\s\p{Punct}\u00A0-\u00BF\u2000-\u206F\u3000-\u303F\uFF01-\uFF0F]+"
MIN_MATCH = 10
#: So many places of benchmark hashes (numbers alone, about 60 bytes each) are broadcast, no more.
MAX_BROADCAST_SEEDS = 400_000
#: So many hits (about 80 bytes each) and characters of items are broadcast; more are joined by shuffle.
MAX_BROADCAST_HITS, MAX_BROADCAST_CHARS = 300_000, 20_000_000
#: So many ids of contaminated documents are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION), "")


def with_seeds(rows: DataFrame, masks: list[str], keys: list[str]) -> DataFrame:
    """keys, at (the window's first token) and seed: one row for each window and mask of the rows'
    words. Exploding the window starts first keeps the hashing, and the join behind it, in generated
    code; the words themselves don't go on."""
    width = min(map(len, masks))
    rows = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("_codes"))
    # Not a filter before: it would cut the text into tokens once more.
    starts = F.when(F.size("_codes") >= width, F.sequence(F.lit(0), F.size("_codes") - width))
    rows = rows.select("*", F.explode(starts).alias("at"))
    hashes = []
    for mask in masks:
        picked = [F.get("_codes", F.col("at") + k) for k, c in enumerate(mask) if c == "1"]
        hashes.append(F.when(F.col("at") + len(mask) <= F.size("_codes"), F.xxhash64(F.lit(int(mask, 2)), *picked)))
    return rows.select(*keys, "at", F.explode(F.array(*hashes)).alias("seed")).filter("seed IS NOT NULL")


def best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """struct(n, start, stop): agreeing tokens of the best stretch and where it lies in the item."""
    zero = [F.lit(0).alias(x) for x in ("score", "n", "start", "best", "best_n", "best_start", "best_stop", "k")]

    def step(a: Column, word: Column) -> Column:
        same = F.get(doc, shift + a["k"]) == word
        same = F.coalesce(same, F.lit(False))
        fresh = a["score"] <= 0
        score = F.greatest(a["score"], F.lit(0)) + F.when(same, 1).otherwise(-MISMATCH)
        n = F.when(fresh, 0).otherwise(a["n"]) + same.cast("int")
        start = F.when(fresh, a["k"]).otherwise(a["start"])
        better = score > a["best"]
        return F.struct(
            score.alias("score"),
            n.alias("n"),
            start.alias("start"),
            F.when(better, score).otherwise(a["best"]).alias("best"),
            F.when(better, n).otherwise(a["best_n"]).alias("best_n"),
            F.when(better, start).otherwise(a["best_start"]).alias("best_start"),
            F.when(better, a["k"] + 1).otherwise(a["best_stop"]).alias("best_stop"),
            (a["k"] + 1).alias("k"),
        )

    found = lambda a: F.struct(a["best_n"].alias("n"), a["best_start"].alias("start"), a["best_stop"].alias("stop"))
    return F.aggregate(item, F.struct(*zero), step, found)


def alignments(docs: DataFrame, benchmark: DataFrame, min_match: int) -> DataFrame:
    """For docs with ROW_KEY: ROW_KEY, item_id, shift and best (a best_stretch) of each hit with enough
    agreeing tokens. A hit is a place of an item along a text, however many seeds meet in it."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("_item"), tokens(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    items = materialize(items, "benchmark-items")
    n, width = F.size("words"), min(map(len, MASKS))
    # Items shorter than every mask are met as a whole: at most width - 1 lengths.
    short = ["1" * r["n"] for r in items.filter(n < width).select(n.alias("n")).distinct().collect()]
    places = ["item_id", "_item"]
    seeds = with_seeds(items.filter(n >= width), list(MASKS), places)
    for mask in short:
        seeds = seeds.unionByName(with_seeds(items.filter(n == len(mask)), [mask], places))
    seeds = materialize(seeds.withColumnRenamed("at", "item_at").distinct(), "benchmark-seeds")
    few = seeds.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS
    windows = with_seeds(docs.select(*ROW_KEY, tokens(F.col("text")).alias("words")), [*MASKS, *short], list(ROW_KEY))
    hits = windows.join(F.broadcast(seeds) if few else seeds, "seed").select(*ROW_KEY, *places, (F.col("at") - F.col("item_at")).alias("shift"))
    hits = materialize(hits.distinct(), "benchmark-hits")
    few = hits.limit(MAX_BROADCAST_HITS + 1).count() <= MAX_BROADCAST_HITS
    other = hits.select(*[F.col(k).alias(f"{k}_hit") for k in ROW_KEY], F.col("item_id").alias("_id"), F.col("_item").alias("_text"), "shift")
    same = F.lit(True)
    for k in ROW_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_hit"))
    met = docs.select(*ROW_KEY, "text").join(F.broadcast(other) if few else other, same)
    small = (items.agg(F.sum(F.length(F.array_join("words", " ")) + 100)).first()[0] or 0) <= MAX_BROADCAST_CHARS
    items = items.withColumnRenamed("words", "item")
    met = met.join(F.broadcast(items) if small else items, F.col("_id").eqNullSafe(F.col("item_id")) & (F.col("_text") == F.col("_item")))
    met = met.withColumn("words", tokens(F.col("text")))
    # The part of the item that lies along the text.
    first = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("item"), F.size("words") - F.col("shift")) - first
    found = best_stretch(F.col("words"), F.slice("item", first + 1, F.greatest(length, F.lit(0))), F.col("shift") + first)
    aligned = met.select(*ROW_KEY, "item_id", F.size("item").alias("item_size"), "shift", first.alias("first"), found.alias("best"))
    # Written first: a filter on the stretch would be pushed down to where the text is cut, into every step.
    aligned = materialize(aligned, "alignments")
    enough = F.least(F.lit(min_match), F.ceil(F.col("item_size") * 0.8).cast("int"))
    moved = F.struct(F.col("best.n").alias("n"), (F.col("best.start") + F.col("first")).alias("start"), (F.col("best.stop") + F.col("first")).alias("stop"))
    return aligned.filter(F.col("best.n") >= enough).select(*ROW_KEY, "item_id", "shift", moved.alias("best"))


def find(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, n_match, doc_start and
    doc_stop (tokens of the longest agreeing stretch)."""
    best = F.max(F.struct(F.col("best.n").alias("n"), (-F.col("shift") - F.col("best.start")).alias("start"), (F.col("shift") + F.col("best.stop")).alias("stop")))
    return (
        alignments(with_row_key(docs.select("doc_id", "text")), benchmark, min_match)
        .groupBy(F.col("_key_id").alias("doc_id"), "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", F.col("b.n").alias("n_match"), (-F.col("b.start")).alias("doc_start"), F.col("b.stop").alias("doc_stop"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents without those that hold a benchmark passage (rows of one doc_id share their
    fate, and so do the rows without one)."""
    bad = materialize(find(docs, benchmark, min_match).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    small = bad.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(bad) if small else bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents without those whose own text holds a benchmark passage: rows that share a doc_id,
    or have none, are judged one by one."""
    bad = alignments(with_row_key(docs.select("doc_id", "text")), benchmark, min_match).select(*ROW_KEY).distinct()
    return without(docs, materialize(bad, "contaminated"), MAX_BROADCAST_IDS)
