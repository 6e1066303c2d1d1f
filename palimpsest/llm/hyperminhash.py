"""HyperMinHash near-duplicates: the documents that the links `100 * |A & B| >= 85 * |A | B|` between their
sets of three-word shingles connect.

1. A set is hashed by `REPLICATES` hash functions, each into `BUCKETS` buckets. A bucket's register keeps
   of its least hash the count of leading zeros and the next `MANTISSA` bits: 16 bits instead of 64, or a
   mark where it is empty. Equal sets are one node from here on.
2. `BAND` registers are a band; nodes that share a band meet in a cell. Two sets of a Jaccard of 0.85 share
   none of the 32 bands with a probability of 6e-11; very small ones differ in so few buckets that they
   always do. Sets of fewer than `SMALLEST` shingles are linked with equal sets alone, so they aren't banded.
3. Of the nodes that met another, the shingles that some other such node has are counted (in packed blocks).
   Where those are fewer than 85 in 100 of its own, a node has no link, and they bound the size of the sets
   that it may be linked with: its reach.
4. The nodes of a cell are compared with its pivot, the one with the greatest share of common shingles. Pairs
   are estimated from their registers first, corrected for registers that are equal by chance; a pair goes on
   unless a link would look as unlike with a probability of less than `MISS`. Then the full sets are
   intersected. What the links connect gets one label.
5. In cells that still have several labels, the registers are compared in blocks: the nodes without the
   pivot's label with all, so a cell whose nodes are linked with their pivot sends nothing. A pair is taken
   up in the first band that it shares, never within a label. What the estimate lets through leaves the task as
   one packed list for a node and a block; lists are confirmed on full sets, too.

A group of copies is one node; a large group of near copies costs a few rows for each node. No cell is held
whole by a task: both steps deal a cell's rows over blocks, and hot cells and sets are joined by
`join_by_size`. Nothing is capped.

Edge cases: a text without words (or null) has the empty set, n_shingles 0, and is linked with nothing; with
fewer than three words the whole sequence is its one shingle. Repeated rows and equal texts are linked. A null
doc_id has a null component_id, is kept and links nobody. Several texts of one doc_id are linked through it
as far as their sets are in the same component; each row is reported by its own set. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_by_size, materialize, pick
from palimpsest.llm.ngram_join import BLOCK_ENTRIES, _mix, _runs, _set_key, dealt, is_small, multiplied, overlaps, relabelled, shared_counts, with_few, word_hashes

WORDS = 3
#: A link needs PERCENT * |union| shared shingles of 100.
PERCENT = 85
#: Of fewer shingles, one shingle more or less is already below PERCENT.
SMALLEST = 6
REPLICATES, BUCKETS, MANTISSA, BAND = 16, 8, 10, 4
REGISTERS, BANDS = REPLICATES * BUCKETS, REPLICATES * BUCKETS // BAND
EMPTY = 0xFFFF
#: The probability with which the estimate may discard a pair of just PERCENT.
MISS = 1e-9
#: Nodes of a block of a cell, about; rows of a part, about (some 300 bytes each).
BLOCK, PART_ROWS = 256, 20_000
#: Cells are broadcast up to so many (some 32 bytes each), else joined by shuffle.
MAX_BROADCAST_CELLS = 1_000_000
#: Shingles that are hashed at once.
PIECE = 1 << 16

_RNG = np.random.default_rng(20250917)
_ODD, _ODD2 = (_RNG.integers(1, 2**63, (REPLICATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACE = _RNG.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)
_LOG_BUCKETS = BUCKETS.bit_length() - 1
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - _LOG_BUCKETS)


# ---- sets and registers


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    hashes = np.full(n, width, np.uint64) * _PLACE[WORDS]
    for k in range(width):
        hashes += _PLACE[k] * words[k : k + n]
    return np.unique(_mix(hashes))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The REGISTERS registers of a set, as uint16: leading zeros above, mantissa below."""
    none = np.uint64(2**64 - 1)
    least = np.full((REPLICATES, BUCKETS), none)
    for at in range(0, len(hashes), PIECE):
        mixed = hashes[None, at : at + PIECE] * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD2
        mixed.sort(axis=1)
        padded = np.concatenate([mixed, np.full((REPLICATES, 1), none)], axis=1)
        begin = np.stack([row.searchsorted(_BOUNDS) for row in mixed])
        full = np.diff(begin, append=mixed.shape[1]) > 0
        value = np.take_along_axis(padded, begin, axis=1) & np.uint64((1 << 64 - _LOG_BUCKETS) - 1)
        least = np.minimum(least, np.where(full, value, none))
    width = 64 - _LOG_BUCKETS
    # Bits up to the leading one; the lowest eight count as one step, so that the rest is exact in doubles.
    length = np.frexp((least >> np.uint64(8)).astype(np.float64))[1] + 8
    mantissa = (least >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    found = ((width - length).clip(0) << MANTISSA) | mantissa.astype(np.int64)
    return np.where(least == none, EMPTY, found).astype(np.uint16).ravel()


def bands_of(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of registers: each band as one number, and which bands have any element."""
    bands = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    return bands, bands != np.uint64(2**64 - 1)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely the registers of two different least hashes are equal, of sets of n and m: the mean width of a
    mantissa step, over exponentially distributed least hashes."""
    return n * m / (n + m) ** 2.0 / (2 * math.log(2)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Jaccard of rows of registers a and b of sets of n and m, corrected for chance, and how many
    registers it is taken from."""
    used = (a != EMPTY) | (b != EMPTY)
    equal, total = ((a == b) & used).sum(axis=1), used.sum(axis=1)
    c = chance(n, m)
    return (equal / np.maximum(total, 1) - c) / (1 - c), total


def _least_estimates() -> np.ndarray:
    """For each number of registers: estimates of links are not above this with a probability of MISS at most."""
    c = float(chance(np.array(1), np.array(1)))
    p, out = PERCENT / 100 + (1 - PERCENT / 100) * c, [-1.0]
    for total in range(1, REGISTERS + 1):
        below, k = (1 - p) ** total, -1
        while below < MISS:
            k += 1
            below += math.comb(total, k + 1) * p ** (k + 1) * (1 - p) ** (total - k - 1)
        out.append((k / total - c) / (1 - c) if k >= 0 else -1.0)
    return np.array(out)


_LEAST = _least_estimates()


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    found, total = estimate(a, b, n, m)
    return found > _LEAST[total] + 1e-12


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (the set's key, null for the empty set) of each row, and its registers, once a set and
    task and only for sets that are banded."""
    schema = "doc_id bigint, has_id boolean, n bigint, k1 bigint, k2 bigint, regs binary"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            rows = []
            for doc_id, has_id, text in zip(batch.doc_id, batch.has_id, batch.text, strict=True):
                hashes, regs = shingle_set(text), None
                if not len(hashes):
                    rows.append((doc_id, has_id, 0, None, None, None))
                    continue
                key = _set_key(hashes)
                if key not in seen and has_id and len(hashes) >= SMALLEST:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    regs = registers(hashes).tobytes()
                rows.append((doc_id, has_id, len(hashes), *key, regs))
            # As objects: beside a null, pandas would make floats of the numbers and round them.
            frame = pd.DataFrame(rows, columns=["doc_id", "has_id", "n", "k1", "k2", "regs"], dtype=object)
            yield frame.astype({"doc_id": "int64", "has_id": "bool", "n": "int64", "k1": "Int64", "k2": "Int64"})

    told = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    made = told.mapInPandas(make, schema).withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
    return materialize(made, "sketches")


# ---- cells


def cells_of(nodes: DataFrame) -> DataFrame:
    """node, cell: the cells in which other nodes are, too. The lowest bits of a cell are its band."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bands, full = bands_of(_regs(batch["regs"]))
                keys = (_mix(bands ^ _SALT) // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                row, band = np.nonzero(full)
                yield pd.DataFrame({"node": batch["node"].to_numpy()[row], "cell": keys[row, band]})

    cells = nodes.filter("regs IS NOT NULL").select("node", "regs").mapInPandas(spread, "node bigint, cell bigint")
    sizes = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "cell-sizes")
    if sizes.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS:
        met = cells.join(F.broadcast(sizes.select("cell")), "cell")
    else:
        met = join_by_size(cells, sizes, ["cell"], "size").drop("size")
    return materialize(met, "cells")


def sets_of(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """node, hashes (sorted, uint64) for the wanted (node, first, k1, k2). repeats: rows may be repeated."""
    rows = pick(docs, "doc_id", "text").join(F.broadcast(wanted) if is_small(wanted) else wanted, F.col("doc_id") == F.col("first"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for node, k1, k2, text in zip(batch["node"], batch["k1"], batch["k2"], batch["text"], strict=True):
                hashes = shingle_set(text)
                # One doc_id may stand on several texts; only the wanted one counts.
                if len(hashes) and _set_key(hashes) == (k1, k2):
                    found.append((node, hashes.tobytes()))
            yield pd.DataFrame(found, columns=["node", "hashes"])

    sets = rows.select("node", "k1", "k2", "text").mapInPandas(make, "node bigint, hashes binary")
    return sets.dropDuplicates(["node"]) if repeats else sets


# ---- pairs


def by_part(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each part's pairs, once a part."""
    need = materialize(pairs.select("part", "node").union(pairs.select("part", F.col("pivot").alias("node"))).distinct(), "need")
    return materialize(with_few(rows.select("node", *columns), need, ["node"]), "parts")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (node, n, pivot, m) that their registers let through."""

    def work(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        regs, place = _regs(sets["regs"]), pd.Index(sets["node"])
        a, b = regs[place.get_indexer(pairs["node"])], regs[place.get_indexer(pairs["pivot"])]
        good = may_link(a, b, pairs["n"].to_numpy(np.float64), pairs["m"].to_numpy(np.float64))
        return pairs.loc[good, ["node", "n", "pivot", "m"]]

    # A row of registers is sent, whatever the size of its set.
    held = dealt(pairs.withColumns({"_n": F.col("n"), "_m": F.col("m"), "n": F.lit(REGISTERS), "m": F.lit(REGISTERS)}))
    held = held.select("node", F.col("_n").alias("n"), "pivot", F.col("_m").alias("m"), "part")
    rows = by_part(held, nodes, "regs")
    return materialize(multiplied(held, rows, work, "node bigint, n bigint, pivot bigint, m bigint", F.col("regs")), "estimated")


def is_link(pairs: pd.DataFrame, shared: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (pairs["n"].to_numpy() + pairs["m"].to_numpy() - shared)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links by their full sets."""

    def work(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        shared = overlaps(pairs, sets)
        return pairs.loc[is_link(pairs, shared), ["node", "pivot"]]

    held = dealt(pairs)
    return materialize(multiplied(held, by_part(held, sets, "hashes"), work, "node bigint, pivot bigint", F.col("hashes")), "links")


def pivot_pairs(cells: DataFrame) -> DataFrame:
    """node, n, pivot, m: each node of a cell with the cell's pivot, where neither is beyond the other's reach."""
    pivots = cells.groupBy("cell").agg(F.max(F.struct("rank", "node", "n", "reach")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = join_by_size(cells, materialize(pivots, "pivots"), ["cell"], "size")
    met = met.filter((F.col("node") != F.col("pivot.node")) & (F.col("pivot.n") <= F.col("reach")) & (F.col("n") <= F.col("pivot.reach")))
    return materialize(met.select("node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m")).distinct(), "pivot-pairs")


def open_pairs(cells: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """part, node, n and, as packed lists, others, sizes, labels: the nodes of other labels that share a cell with
    a node, are within its reach and it within theirs, and pass the estimate. A row is a node and a block of a cell."""
    told = materialize(with_few(cells, labels, ["node"]), "labelled-cells")
    groups = told.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("rank", "node", "label")).alias("pivot"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups.filter("low <> high").select("cell", "size", F.col("pivot.label").alias("main")), "open-cells")
    rows = join_by_size(told, groups, ["cell"], "size").withColumn("is_main", F.col("label") == F.col("main")).drop("main", "size")
    kinds = rows.groupBy("cell").agg(F.count_if("is_main").alias("mains"), F.count_if(~F.col("is_main")).alias("size"))
    # At least one of each, so that both have a block.
    kinds = kinds.select("cell", F.greatest(F.ceil(F.col("mains") / BLOCK), F.lit(1)).cast("int").alias("main_blocks"), F.ceil(F.col("size") / BLOCK).cast("int").alias("other_blocks"), (F.col("mains") + F.col("size")).alias("size"))
    rows = join_by_size(rows, materialize(kinds, "cell-blocks"), ["cell"], "size").drop("size")
    deal = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    own = F.when(F.col("is_main"), deal("main_blocks")).otherwise(deal("other_blocks"))
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    # Blocks are numbered: main ones first, then the others; a group is an other block and any block.
    with_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    with_other = F.transform(others, lambda j: F.struct(F.least(F.col("own"), j).alias("i"), (F.col("main_blocks") + F.greatest(F.col("own"), j)).alias("j")))
    of_main = F.transform(others, lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    rows = rows.withColumn("own", own).withColumn("group", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_other))))
    rows = rows.select("node", "n", "reach", "label", "is_main", F.pmod("cell", F.lit(BANDS)).cast("int").alias("band"), F.xxhash64("cell", "group.i", "group.j").alias("key"), (F.col("group.j") >= F.col("main_blocks")).alias("is_inner"))
    rows = materialize(rows, "open-rows")
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    held = with_few(nodes.select("node", "regs"), materialize(rows.select("node").distinct(), "open-nodes"), ["node"])
    held = rows.join(F.broadcast(held) if is_small(held) else held, "node").withColumn("part", F.pmod("key", F.lit(parts)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        key, node, n, reach, label = (frame[c].to_numpy() for c in ("key", "node", "n", "reach", "label"))
        is_main, is_inner, band = (frame[c].to_numpy() for c in ("is_main", "is_inner", "band"))
        regs = _regs(frame["regs"])
        bands, full = bands_of(regs)
        out = []
        for a, b in _runs(key):
            at = np.arange(a, b)
            if is_inner[a]:
                left = right = at
            else:
                left, right = at[~is_main[a:b]], at[is_main[a:b]]
            step = max(1, 2_000_000 // (BANDS * max(1, len(right))))
            for low in range(0, len(left), step):
                own = left[low : low + step]
                allowed = (label[own, None] != label[None, right]) & (n[own, None] <= reach[None, right]) & (n[None, right] <= reach[own, None])
                if is_inner[a]:
                    allowed &= node[own, None] < node[None, right]
                x, y = np.nonzero(allowed)
                x, y = own[x], right[y]
                # Each pair in the first band that it shares.
                same = (bands[x] == bands[y]) & full[x]
                first = same.argmax(axis=1) == band[a]
                x, y = x[first], y[first]
                good = may_link(regs[x], regs[y], n[x].astype(np.float64), n[y].astype(np.float64))
                x, y = x[good], y[good]
                for low_, high_ in _runs(x):
                    own_, met = x[low_], y[low_:high_]
                    out.append((int(key[a]), int(node[own_]), int(n[own_]), node[met].tobytes(), n[met].tobytes(), label[met].tobytes()))
        return pd.DataFrame(out, columns=["key", "node", "n", "others", "sizes", "labels"])

    found = materialize(held.groupBy("part").applyInPandas(work, "key bigint, node bigint, n bigint, others binary, sizes binary, labels binary"), "open-pairs")
    # Rows of a block share most of their sets, so a part may have several times BLOCK_ENTRIES in pairs.
    entries = found.agg(F.sum(F.col("n") * (1 + F.octet_length("others") / 8))).first()[0] or 0
    parts = max(1, math.ceil(entries / (4 * BLOCK_ENTRIES)))
    return found.select(F.pmod("key", F.lit(parts)).alias("part"), "node", "n", "others", "sizes", "labels")


def confirmed_open(found: DataFrame, sets: DataFrame) -> DataFrame:
    """node, pivot: of the pairs of open_pairs() those that are links by their full sets, one for a node, its block
    and a label."""

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, rows in batch.groupby("part"):
                met = np.concatenate([rows["node"].to_numpy(), *(np.frombuffer(x, np.int64) for x in rows["others"])])
                yield pd.DataFrame({"part": part, "node": np.unique(met)})

    def work(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        lists = {c: [np.frombuffer(x, np.int64) for x in rows[c]] for c in ("others", "sizes", "labels")}
        times = [len(x) for x in lists["others"]]
        pairs = pd.DataFrame({"row": np.repeat(np.arange(len(rows)), times), "node": np.repeat(rows["node"].to_numpy(), times), "n": np.repeat(rows["n"].to_numpy(), times)})
        pairs = pairs.assign(**{name: np.concatenate(lists[c]) if times else np.zeros(0, np.int64) for name, c in (("pivot", "others"), ("m", "sizes"), ("label", "labels"))})
        good = is_link(pairs, overlaps(pairs, sets))
        return pairs[good].drop_duplicates(["row", "label"])[["node", "pivot"]]

    need = materialize(found.select("part", "node", "others").mapInPandas(needs, "part bigint, node bigint").distinct(), "need")
    own = materialize(with_few(sets.select("node", "hashes"), need, ["node"]), "parts")
    return materialize(multiplied(found, own, work, "node bigint, pivot bigint", F.col("hashes")), "links")


# ---- components


def labels_of(docs: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """node, label: nodes that links connect have one label. Nodes without a link may be missing."""
    cells = cells_of(nodes)
    met = with_few(nodes.select("node", "first", "k1", "k2", "n"), materialize(cells.select("node").distinct(), "met"), ["node"])
    sets = materialize(sets_of(docs, met.select("node", "first", "k1", "k2"), repeats), "sets")
    entries = met.agg(F.sum("n")).first()[0] or 0
    counts = shared_counts(sets.select(F.col("node").alias("key"), "hashes"), entries, 16)
    # Of an overlap of s shingles at most, a link leads to sets of 100 s >= PERCENT (n + m - s) at most.
    reach = F.floor((100 + PERCENT) * F.col("shared") / PERCENT - F.col("n"))
    left = met.join(counts.withColumnRenamed("key", "node"), "node").withColumn("reach", reach).filter(100 * F.col("shared") >= PERCENT * F.col("n"))
    left = materialize(left.select("node", "n", "reach", F.floor(1000 * F.col("shared") / F.col("n")).cast("int").alias("rank")), "left")
    cells = materialize(with_few(cells, left, ["node"]), "left-cells")
    labels = left.select("node", F.col("node").alias("label"))
    links = confirmed(estimated(pivot_pairs(cells), nodes), sets)
    labels = relabelled(labels, links)
    return relabelled(labels, confirmed_open(open_pairs(cells, labels, nodes), sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows = sketches(docs)
    known = rows.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    nodes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.max("regs").alias("regs"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    repeats = not known.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").isEmpty()
    grouped = nodes.join(labels_of(docs, nodes, repeats), "node", "left").select("k1", "k2", "size", "first", "label")
    grouped = materialize(grouped.filter("size > 1 OR label IS NOT NULL"), "groups")
    least = grouped.groupBy("label").agg(F.min("first").alias("least")).filter("label IS NOT NULL")
    of_set = grouped.join(least, "label", "left").select("k1", "k2", "size", F.coalesce("least", "first").alias("component"))
    found = join_by_size(rows.select("doc_id", "n", "k1", "k2"), materialize(of_set, "components"), ["k1", "k2"], "size", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
