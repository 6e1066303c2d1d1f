"""N-gram Jaccard join: the documents that the links `100 * |A & B| >= 80 * |A | B|` between their
sets of five-word shingles connect, by a blocked sparse matrix product.

Rows are documents, columns shingles. The product of the matrix with its transpose counts shared
shingles; a link is a count that reaches the bound which the two sizes set,
`|A & B| >= 4 (|A| + |B|) / 9`.

1. Equal sets are one row. Counts over blocks of columns discard rows: a row with more columns of
   its own than any link allows (`n - ceil(0.8 n) + 1`) has no link. `HEAD` of the columns is counted
   for all rows, which discards most; the rest only for those that are left.
2. Of a row that is left, the least common columns of its size-derived prefix are kept: two linked
   rows share one of them. The rows that meet in a column, and are of like size, are a block. Instead
   of all pairs in a block, each row is multiplied with the block's pivot, the row that shares most of
   its columns, so a block of m rows costs m - 1 counts (in later rounds with a bounded number of pivots).
3. The counts come from blocks of rows by blocks of columns, sets being sent once a block and not once
   a pair. Overlaps of the first columns are summed for all pairs; pairs that the columns still to come
   can't lift to the bound are discarded; the others get the rest added.
4. What a pivot p leaves open are pairs (x, y) of a block of three or more rows of which one is not
   in the component of p. Where that is little (`LEFT_ENTRIES`), the open rows are multiplied with all
   rows of the pivot, in blocks by blocks, which leaves nothing open.
   Of larger groups, rows differ from p by known sets D(x), D(y), and as |A & B| follows from
   |D(x) & D(y)|, these sets are the rows of a smaller product with a size-derived bound of its own.
   Their prefixes are the columns of the next round. Pivots are settled with every row of their
   block, so blocks get smaller, and rounds go on until none leaves a pair open.
5. Links are contracted into components by rounds of taking the least neighbour, after each round, as
   pairs within a component need no count.

A large group of copies is one row, a large group of near copies costs a few counts for each member,
and no step lists the pairs of a group. A column of many rows is counted where it is met and sends
one entry a task; keys of so many rows that one task would feel it (`join_by_size`, a bounded number)
are joined by broadcast; the members of a pivot are dealt over blocks of `MEMBERS`. Shingles are
compared by 64-bit hashes of their words' 64-bit hashes, sets by 128 bits.

Edge cases: a text without words (or null) has the empty set, n_shingles 0, and is linked with
nothing; with fewer than five words the whole sequence is its one shingle. Repeated rows and equal
texts are linked. A null doc_id has a null component_id and links nobody. An empty table gives an
empty result. Long texts are cut into words a piece at a time. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import MAX_HOT, ROW_KEY, giving_back, join_by_size, materialize, pick, with_row_key

WORDS = 5
#: The columns counted for all rows, in sixteenths of the hash range (above the fifth that a row may differ by).
HEAD = 5
#: Entries of a block, about: 16 bytes each, some copies of them in a task's memory.
BLOCK_ENTRIES = 1_500_000
#: Entries that a task holds while it counts columns.
TASK_ENTRIES = 600_000
#: Rows that a block holds of a pivot, at most.
MEMBERS = 256
#: Pivots of a column after the first turn: of up to MEMBERS rows, of more.
SLOTS, FEW = 64, 4
#: What a pivot leaves open is multiplied at once if its rows, once a block, have so many entries at most.
LEFT_ENTRIES = 1 << 23
#: Rows of a side of such a block at most, and columns that are multiplied at once.
SIDE, WIDTH = 512, 4_096
#: Columns of more rows, and of a MAX_HOT-th of the entries, are known to every task: MAX_HOT at most.
FREQUENT_ROWS = 1_000
#: Identifiers are broadcast up to so many (some 40 bytes each), else joined by shuffle.
MAX_BROADCAST_IDS = 300_000
#: Or, to choose among whole texts, as bits of 64 neighbours, up to so many numbers (some 50 bytes each).
MAX_BROADCAST_BITS = 1_000_000
#: Bytes of a text that are cut into words at once; bytes of shorter texts that are, about.
PIECE, TOGETHER = 1 << 22, 1 << 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

# ---- shingle hashes

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_IS_GAP = bytes(b in b"\x20\x09\x0a\x0b\x0c\x0d" for b in range(256))
#: Masks of the first 0 to 8 of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE = np.random.default_rng(20240229).integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of data (of lower case), and where they begin. Eight bytes of all words are
    mixed in at a time."""
    raw = b"".join((data, b" ", bytes(8)))
    is_gap = np.frombuffer(raw.translate(_IS_GAP), bool, len(data) + 1)
    starts = np.flatnonzero(is_gap[:-1] > is_gap[1:]) + 1
    if not is_gap[0]:
        starts = np.concatenate([[0], starts])
    lengths = np.flatnonzero(is_gap[1:] > is_gap[:-1]) + 1 - starts
    eights = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    hashes = _mix((eights[starts] & _FIRST[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _PLACE[0]))
    at, longer = 8, np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    while len(longer):
        more = eights[starts[longer] + at] & _FIRST[np.minimum(lengths[longer] - at, 8)]
        hashes[longer] = _mix(hashes[longer] + more)
        at += 8
        longer = longer[lengths[longer] > at]
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return hashes, starts


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def word_hashes(text: str) -> np.ndarray:
    data, at, parts = _lower(text), 0, []
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        parts.append(_hashed(data[at:end])[0])
        at = end
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each WORDS words in a row."""
    n = max(0, len(words) - WORDS + 1)
    hashes = _PLACE[0] * words[:n]
    for k in range(1, WORDS):
        hashes += _PLACE[k] * words[k : k + n]
    return _mix(hashes)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _as_set(words: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    if len(shingles):
        return _distinct(shingles)
    if not len(words):
        return words
    whole = (_PLACE[: len(words)] * words).sum(dtype=np.uint64, keepdims=True)
    return _mix(whole + _PLACE[WORDS:] * np.array([len(words)], np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    return _as_set(words, _shingles(words))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """shingle_set of each text. Texts are hashed together, up to TOGETHER bytes or so."""
    held: list[bytes] = []

    def sets() -> Iterator[np.ndarray]:
        words, starts = _hashed(b" ".join(held))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held])).tolist()
        shingles = _shingles(words)
        for a, b in zip([0, *ends], ends, strict=False):
            yield _as_set(words[a:b], shingles[a : max(a, b - WORDS + 1)])

    size = 0
    for text in texts:
        if text and len(text) > PIECE:
            if held:
                yield from sets()
            held, size = [], 0
            yield shingle_set(text)
            continue
        held.append(_lower(text or ""))
        size += len(held[-1])
        if size > TOGETHER:
            yield from sets()
            held, size = [], 0
    if held:
        yield from sets()


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (both & (1 << 64) - 1) - (1 << 63), (both >> 64) - (1 << 63)


# ---- bounds


def prefix_length(n: int) -> int:
    """Columns of a set of n that some partner with a Jaccard of 0.8 must share one of."""
    return n - (4 * n + 4) // 5 + 1


def prefix_of(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def difference_prefix(a: int, n: int, p: int, is_linked: bool) -> int:
    """How many of the a elements in which a row of size n differs from its pivot (size p) must
    be columns, so that every link of the pivot's open pairs shares one.

    For a partner of size m that differs by e, a link needs at least (9 (a + e) - n - m) / 18
    common differences, never more than e; e >= |m - p|; and at least one of the two is not linked
    to the pivot, which for the partner means 9 e > m + p. The least need over all m sets the length."""
    m = np.arange((4 * n + 4) // 5, 5 * n // 4 + 1)
    e = np.maximum(np.abs(m - p), -((n + m - 9 * a) // 9))
    if is_linked:
        e = np.maximum(e, (m + p) // 9 + 1)
    need = np.maximum(1, -((n + m - 9 * (a + e)) // 18))
    return max(0, a - int(need.min()) + 1)


# ---- joins on keys that may be hot


def is_small(ids: DataFrame) -> bool:
    return ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS


def with_few(rows: DataFrame, ids: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(ids) if is_small(ids) else ids, keys, how)


def among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with ids (doc_id) as left_semi or left_anti. Texts don't move: which ids there are is
    known to every task, 64 neighbours as the bits of a number. Ids too far apart for that are joined by
    shuffle."""
    if is_small(ids):
        return docs.join(F.broadcast(ids), ["doc_id"], how).select(*docs.columns)
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    bits = materialize(ids.groupBy(F.shiftright("doc_id", 6).alias("_ids_at")).agg(F.bit_or(bit).alias("_ids_bits")), "id-bits")
    if bits.limit(MAX_BROADCAST_BITS + 1).count() > MAX_BROADCAST_BITS:
        return docs.join(ids, ["doc_id"], how).select(*docs.columns)
    is_in = F.coalesce(F.expr("(shiftright(_ids_bits, cast(doc_id & 63 as int)) & 1) = 1"), F.lit(False))
    found = docs.join(F.broadcast(bits), F.shiftright("doc_id", 6) == F.col("_ids_at"), "left")
    return found.filter(is_in if how == "left_semi" else ~is_in).select(*docs.columns)


# ---- rows of the matrix


def sets_in(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (the set's key, null for the empty set) for each row, and head: its hashes in
    the first columns, once a set and task."""
    schema = "doc_id bigint, has_id boolean, n bigint, k1 bigint, k2 bigint, n_head int, head binary"
    limit = np.uint64(HEAD << 60)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            rows = []
            for doc_id, has_id, hashes in zip(batch.doc_id, batch.has_id, shingle_sets(batch.text), strict=True):
                head = None
                if not len(hashes):
                    rows.append((doc_id, has_id, 0, None, None, 0, None))
                    continue
                key, n_head = _set_key(hashes), int(np.searchsorted(hashes, limit))
                if key not in seen and has_id:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    head = hashes[:n_head].tobytes()
                rows.append((doc_id, has_id, len(hashes), *key, n_head, head))
            # As objects: beside a null, pandas would make floats of the numbers and round them.
            frame = pd.DataFrame(rows, columns=["doc_id", "has_id", "n", "k1", "k2", "n_head", "head"], dtype=object)
            yield frame.astype({"doc_id": "int64", "has_id": "bool", "n": "int64", "k1": "Int64", "k2": "Int64", "n_head": "int64"})

    told = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    made = told.mapInPandas(giving_back(make), schema).withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
    return materialize(made, "sets-in")


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = _cuts(sorted_values).tolist()
    return list(zip(cuts, [*cuts[1:], len(sorted_values)], strict=False))


def _sum_by(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    order = np.argsort(keys, kind="stable")
    at = _cuts(keys[order])
    return pd.DataFrame({"key": keys[order][at], "shared": np.add.reduceat(values[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)})


def shared_counts(rows: DataFrame, entries: int, sixteenths: int) -> DataFrame:
    """key, shared: how many of its columns (in the first sixteenths of the range) each row shares
    with another. rows: key, hashes. Within a block a column is known by 32 bits, so a count may be
    too high, never too low. What a block counted is sent as one list for each range of keys, not as
    a row for each key, as a larger table has more blocks and a row is counted in each."""
    bits = max(0, math.ceil(math.log2(max(1, entries / (sixteenths * BLOCK_ENTRIES)))))
    shift = 60 - bits

    def by_range(counts: pd.DataFrame) -> Iterator[tuple[int, bytes, bytes]]:
        key = counts["key"].to_numpy(np.int64)
        place = key & (2 << bits) - 1
        order = np.argsort(place, kind="stable")
        key, shared, place = key[order], counts["shared"].to_numpy(np.uint32)[order], place[order]
        return ((int(place[a]), key[a:b].tobytes(), shared[a:b].tobytes()) for a, b in _runs(place))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Columns that two rows at hand share are counted here; one entry of each goes to its block
        (marked as counted), beside the entries of columns met once."""
        keys, parts, held = [], [], 0

        def sent() -> Iterator[pd.DataFrame]:
            hashes = np.concatenate(parts)
            own = np.repeat(np.array(keys, np.int64), [len(p) for p in parts])
            order = np.lexsort((own, hashes))
            hashes, own = hashes[order], own[order]
            once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])])
            hashes, own = hashes[once], own[once]
            at = _cuts(hashes)
            sizes = np.diff(np.append(at, len(hashes)))
            many = np.repeat(sizes > 1, sizes)
            counts = _sum_by(own[many], np.ones(int(many.sum()), np.int64))
            # Counts go by their ranges of keys, below the blocks of columns.
            ready = [(-1 - place, key, shared, b"") for place, key, shared in by_range(counts)]
            hashes, own, counted = hashes[at], own[at], (sizes > 1).astype(np.uint8)
            block = (hashes >> np.uint64(shift)).astype(np.int64)
            short = (hashes >> np.uint64(max(0, shift - 32))).astype(np.uint32)
            pieces = [(int(block[a]), own[a:b].tobytes(), short[a:b].tobytes(), counted[a:b].tobytes()) for a, b in _runs(block)]
            yield pd.DataFrame(ready + pieces, columns=["block", "keys", "values", "counted"])

        for batch in batches:
            for key, data in zip(batch["key"], batch["hashes"], strict=True):
                if data:
                    keys.append(key)
                    parts.append(np.frombuffer(data, np.uint64))
                    held += len(parts[-1])
                if held > TASK_ENTRIES:
                    yield from sent()
                    keys, parts, held = [], [], 0
        if held:
            yield from sent()

    def lists(counts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(by_range(counts), columns=["place", "keys", "values"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return _sum_by(np.concatenate([np.frombuffer(x, np.int64) for x in frame["keys"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in frame["values"]]))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["block"].iloc[0] < 0:
            return lists(total(frame))
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in frame["keys"]])
        values = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["values"]])
        counted = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["counted"]])
        order = np.lexsort((keys, values))
        keys, values, counted = keys[order], values[order], counted[order]
        at = _cuts(values)
        sizes = np.diff(np.append(at, len(values)))
        # The same row may come from two tasks: a column is shared if two keys or a counted entry meet there.
        other = (np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)) | (np.maximum.reduceat(counted, at) > 0)
        fresh = np.repeat(other, sizes) & (counted == 0)
        fresh &= np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1]) | (counted[:-1] > 0)])
        return lists(_sum_by(keys[fresh], np.ones(int(fresh.sum()), np.int64)))

    packed = rows.select("key", "hashes").mapInPandas(giving_back(local), "block bigint, keys binary, values binary, counted binary")
    found = packed.groupBy("block").applyInPandas(count, "place bigint, keys binary, values binary")
    return found.groupBy("place").applyInPandas(total, "key bigint, shared bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """node, n, hashes (sorted, uint64) for the wanted (node, first, k1, k2). repeats: rows may be
    repeated."""
    rows, is_first = pick(docs, "doc_id", "text"), F.col("doc_id") == F.col("first")
    if is_small(wanted):
        rows = rows.join(F.broadcast(wanted), is_first)
    else:
        rows = among(rows, wanted.select(F.col("first").alias("doc_id")), "left_semi").join(wanted, is_first)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for node, k1, k2, hashes in zip(batch.node, batch.k1, batch.k2, shingle_sets(batch.text), strict=True):
                # One doc_id may stand on several texts; only the wanted one counts.
                if len(hashes) and _set_key(hashes) == (k1, k2):
                    found.append((node, len(hashes), hashes.tobytes()))
            yield pd.DataFrame(found, columns=["node", "n", "hashes"])

    sets = rows.select("node", "k1", "k2", "text").mapInPandas(giving_back(make), "node bigint, n bigint, hashes binary")
    return sets.dropDuplicates(["node"]) if repeats else sets


def frequent_columns(sets: DataFrame, entries: int) -> np.ndarray:
    """The columns of more than FREQUENT_ROWS rows (and of a MAX_HOT-th of the entries), with their
    counts (as far as a task met them twice): two rows of uint64, MAX_HOT columns at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def counted() -> pd.DataFrame:
            values = np.sort(np.concatenate(held))
            at = _cuts(values)
            counts = np.diff(np.append(at, len(values)))
            return pd.DataFrame({"column": values[at][counts > 1].view(np.int64), "n": counts[counts > 1]})

        for batch in batches:
            for data in batch["hashes"]:
                held.append(np.frombuffer(data, np.uint64))
                n += len(held[-1])
                if n > TASK_ENTRIES:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    found = sets.select("hashes").mapInPandas(giving_back(count), "column bigint, n bigint").groupBy("column").agg(F.sum("n").alias("n"))
    least = max(FREQUENT_ROWS, entries // MAX_HOT)
    top = found.filter(F.col("n") > least).orderBy(F.desc("n"), "column").limit(MAX_HOT).toPandas().sort_values("column", key=lambda c: c.to_numpy(np.int64).view(np.uint64))
    return np.stack([top.column.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.int64).view(np.uint64)])


def _among(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are in the sorted known, and where."""
    at = np.searchsorted(known, hashes)
    if not len(known):
        return np.zeros(len(hashes), bool), at
    at = np.minimum(at, len(known) - 1)
    return known[at] == hashes, at


def with_commonness(sets: DataFrame) -> DataFrame:
    """sets (node, n, hashes) that share enough columns with others to be linked, with often: for
    each hash, by how many of the sets it is met (uint32, 1 is none but this), and reach: the size of
    the largest set that a link could lead to, as what one set alone has is in no overlap."""
    spark = sets.sparkSession
    entries = sets.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(frequent_columns(sets, entries))
    bits = min(31, max(0, math.ceil(math.log2(max(1, entries / BLOCK_ENTRIES)))))
    places = 2 << bits

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, parts, held = [], [], 0

        def sent() -> pd.DataFrame:
            hashes = np.concatenate(parts)
            own = np.repeat(np.array(nodes, np.int64), [len(p) for p in parts])
            block = hashes >> np.uint64(32) >> np.uint64(32 - bits)
            order = np.argsort(block, kind="stable")
            hashes, own, block = hashes[order], own[order], block[order]
            return pd.DataFrame([(int(block[a]), own[a:b].tobytes(), hashes[a:b].tobytes()) for a, b in _runs(block)], columns=["block", "nodes", "hashes"])

        for batch in batches:
            for node, data in zip(batch.node, batch.hashes, strict=True):
                hashes = np.frombuffer(data, np.uint64)
                rare = hashes[~_among(hashes, frequent.value[0])[0]]
                nodes.append(node)
                parts.append(rare)
                held += len(rare)
                if held > TASK_ENTRIES:
                    yield sent()
                    nodes, parts, held = [], [], 0
        if held:
            yield sent()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([np.frombuffer(x, np.int64) for x in frame["nodes"]])
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["hashes"]])
        order = np.argsort(hashes)
        own, hashes = own[order], hashes[order]
        at = _cuts(hashes)
        sizes = np.diff(np.append(at, len(hashes)))
        often = np.repeat(sizes, sizes)
        keep = often > 1
        own, hashes, often = own[keep], hashes[keep], often[keep].astype(np.uint32)
        place = own + (own >> 33) & places - 1
        order = np.argsort(place)
        own, hashes, often, place = own[order], hashes[order], often[order], place[order]
        found = [(int(place[a]), own[a:b].tobytes(), hashes[a:b].tobytes(), often[a:b].tobytes()) for a, b in _runs(place)]
        return pd.DataFrame(found, columns=["place", "nodes", "shared", "counts"])

    def put_together(sets: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        own, shared, counts = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in met[c])]) for c, kind in (("nodes", np.int64), ("shared", np.uint64), ("counts", np.uint32)))
        order = np.argsort(own)
        own, shared, counts = own[order], shared[order], counts[order]
        begin, end = (np.searchsorted(own, sets["node"].to_numpy(), side) for side in ("left", "right"))
        rows = []
        for node, n, data, a, b in zip(sets["node"], sets["n"], sets["hashes"], begin, end, strict=True):
            hashes, often = np.frombuffer(data, np.uint64), np.ones(n, np.uint32)
            is_frequent, at = _among(hashes, frequent.value[0])
            often[is_frequent] = np.minimum(frequent.value[1][at[is_frequent]], np.uint64(2**31))
            often[np.searchsorted(hashes, shared[a:b])] = counts[a:b]
            alone = int((often == 1).sum())
            if alone < prefix_length(n):
                # The top bits are the share of common columns: the greatest node of a block is
                # the one nearest to what the others share.
                rank = (31 * (n - alone) // n << 58) | node
                order = np.lexsort((hashes, often))[alone : prefix_length(n)]
                quarter = int(np.searchsorted(hashes, np.uint64(1 << 62)))
                rows.append((node, rank, n, 9 * (n - alone) // 4 - n, quarter, data, often.tobytes(), hashes[order].view(np.int64)))
        return pd.DataFrame(rows, columns=["id", "node", "n", "reach", "n_first", "hashes", "often", "columns"])

    # What a block counted goes to its sets as one list for each range of them, not as a row for each set: a
    # larger table has more blocks, and a set columns in most of them.
    packed = sets.select("node", "hashes").mapInPandas(giving_back(spread), "block bigint, nodes binary, hashes binary")
    met = packed.groupBy("block").applyInPandas(count, "place bigint, nodes binary, shared binary, counts binary")
    place = (F.col("node") + F.shiftright("node", 33)).bitwiseAND(places - 1).alias("place")
    schema = "id bigint, node bigint, n bigint, reach bigint, n_first bigint, hashes binary, often binary, columns array<bigint>"
    return sets.select(place, "node", "n", "hashes").groupBy("place").cogroup(met.groupBy("place")).applyInPandas(put_together, schema)


# ---- blocks, pivots and products


def pairs_of(cells: DataFrame, turn: int) -> DataFrame:
    """Of cells (node, n, reach, label, column, is_open): the pairs (node, n, pivot, m, is_wide) of a row
    and a pivot of a column. A pair may be a link between components if its labels differ, one of its
    rows is open, and neither size is beyond the other's reach; so one of them is central, its reach not
    below its own size. Columns without such pairs fall out.

    Pivots are the central rows, or the open ones where those are fewer: in the first turn the greatest,
    later the greatest of each of `SLOTS` slots, into which the column's rows fall by hash, or of them
    the `FEW` greatest in a column of more than MEMBERS rows. is_wide: the pair's pivot is the column's
    greatest, and there are pairs left in which this row, no pivot, may have a part."""
    central = F.col("reach") >= F.col("n")
    highest = [F.max(F.when(is_one, F.col("node"))).alias(c) for c, is_one in (("open_row", F.col("is_open")), ("central_row", central))]
    counts = [F.count(F.lit(1)).alias("size"), F.count_if("is_open").alias("open"), F.count_if(central).alias("central")]
    ends = lambda low, high: [F.min(low).alias("low"), F.max(high).alias("high")]
    if turn:
        slot = F.pmod(F.xxhash64("column", "node", F.lit(turn)), F.lit(SLOTS)).alias("slot")
        listed = [F.sort_array(F.collect_list(c), asc=False).alias(c) for c in ("open_row", "central_row")]
        parts = cells.groupBy("column", slot).agg(*highest, *ends("label", "label"), *counts)
        groups = parts.groupBy("column").agg(*listed, *ends("low", "high"), *[F.sum(c).alias(c) for c in ("size", "open", "central")])
    else:
        groups = cells.groupBy("column").agg(*highest, *ends("label", "label"), *counts).withColumns({c: F.array(c) for c in ("open_row", "central_row")})
    groups = groups.filter("open > 0 AND central > 0 AND low <> high")
    pivots = F.when(F.col("central") <= F.col("open"), F.col("central_row")).otherwise(F.col("open_row"))
    groups = groups.withColumn("pivots", F.when(F.col("size") > MEMBERS, F.slice(pivots, 1, FEW)).otherwise(pivots))
    left = (F.least("open", "central") > F.size("pivots")) & (F.col("size") - F.size("pivots") > 1)
    # Of rows only the numbers are sorted out above, so that no aggregate has to sort its input.
    told = materialize(cells.select("node", "n", "reach", "label").dropDuplicates(["node"]), "rows-met")
    groups = with_few(groups.select("column", "size", left.alias("is_left"), F.explode("pivots").alias("node")), told, ["node"])
    row = F.struct("node", "n", "reach", "label")
    if turn:
        groups = groups.groupBy("column", "size", "is_left").agg(F.sort_array(F.collect_list(row), asc=False).alias("pivots"))
    else:
        groups = groups.withColumn("pivots", F.array(row))
    groups = materialize(groups.select("column", "pivots", "size", "is_left"), "blocks")
    met = join_by_size(cells, groups, ["column"], "size")
    met = met.withColumn("is_pivot", F.exists("pivots", lambda p: p["node"] == F.col("node"))).withColumn("pivot", F.explode("pivots"))
    wide = F.col("is_left") & ~F.col("is_pivot") & (F.col("pivot.node") == F.get("pivots", 0)["node"])
    may_link = (F.col("label") != F.col("pivot.label")) & (F.col("pivot.n") <= F.col("reach")) & (F.col("n") <= F.col("pivot.reach"))
    # Of two pivots each once.
    met = met.withColumn("is_wide", wide).filter(F.col("is_wide") | (may_link & (~F.col("is_pivot") | (F.col("node") < F.col("pivot.node")))))
    met = met.groupBy("node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m")).agg(F.max("is_wide").alias("is_wide"))
    return materialize(met, "pairs")


def size_cells(rows: DataFrame) -> DataFrame:
    """First-round cells. A row is open in the class of its size and stands in the next class
    too, not open, for partners there; sizes of linked sets are a class apart at most."""
    size = F.floor(F.log("n") / math.log(1.26)).cast("int")
    spread = rows.select("node", "n", "reach", F.explode("columns").alias("column")).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    return spread.select("node", "n", "reach", F.col("node").alias("label"), F.xxhash64("column", size + F.col("step")).alias("column"), (F.col("step") == 0).alias("is_open"))


def dealt(pairs: DataFrame) -> DataFrame:
    """pairs with `part`: the block of rows in which they are multiplied, of about BLOCK_ENTRIES."""
    members = pairs.groupBy("pivot", "m").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("entries"))
    members = materialize(members.withColumn("salts", F.ceil(F.col("size") / MEMBERS)), "pivots")
    total = members.agg(F.sum(F.col("entries") + F.col("m") * F.col("salts"))).first()[0] or 0
    parts = max(1, math.ceil(total / BLOCK_ENTRIES))
    joined = join_by_size(pairs, members.select("pivot", "size", "salts"), ["pivot"], "size")
    salt = F.pmod(F.xxhash64("node"), F.col("salts"))
    part = F.pmod(F.xxhash64("pivot", salt), F.lit(parts))
    return materialize(joined.select(*pairs.columns, part.alias("part")), "dealt")


def sets_by_part(need: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that each part needs (part, node), once a part."""
    need = materialize(need.distinct(), "need")
    return materialize(with_few(rows, need, ["node"]).select("part", "node", "n", "n_first", "hashes", "often"), "parts")


def multiplied(pairs: DataFrame, sets: DataFrame, work, schema: str, *columns: Column) -> DataFrame:
    """work(pairs, sets) on each part, where sets has node and the columns of the rows in its pairs."""
    return pairs.groupBy("part").cogroup(sets.select("part", "node", *columns).groupBy("part")).applyInPandas(work, schema)


def overlaps(pairs: pd.DataFrame, sets: pd.DataFrame) -> np.ndarray:
    """The product of the block: for each pair, the columns that its two sets share."""
    lengths = np.array([len(x) // 8 for x in sets["hashes"]], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.frombuffer(b"".join(sets["hashes"]), np.uint64)
    values, code = np.unique(hashes, return_inverse=True)
    cells = np.repeat(np.arange(len(lengths)), lengths) * len(values) + code
    place = pd.Index(sets["node"])
    left, right = place.get_indexer(pairs["node"]), place.get_indexer(pairs["pivot"])
    shared = np.zeros(len(pairs), np.int64)
    upto = np.cumsum(lengths[left])
    at = 0
    while at < len(pairs):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_ENTRIES)))
        n = lengths[left[at:end]]
        where = np.repeat(starts[left[at:end]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        wanted = np.repeat(right[at:end], n) * len(values) + code[where]
        hit = np.minimum(np.searchsorted(cells, wanted), max(0, len(cells) - 1))
        found = cells[hit] == wanted if len(cells) else np.zeros(0, bool)
        shared[at:end] = np.bincount(np.repeat(np.arange(end - at), n), found, minlength=end - at)
        at = end
    return shared


PAIR = "node bigint, n bigint, pivot bigint, m bigint, is_wide boolean, part bigint, shared bigint"


def product(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with is_link: overlaps summed over the blocks of columns. Pairs that the bound discards
    on the way are not in it, unless they are wide."""

    def first(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        shared = overlaps(pairs, sets)
        rest = pd.Series(sets["rest"].to_numpy(), sets["node"].to_numpy())
        most = shared + np.minimum(rest.loc[pairs["node"]].to_numpy(), rest.loc[pairs["pivot"]].to_numpy())
        live = pairs["is_wide"].to_numpy(bool) | (9 * most >= 4 * (pairs["n"] + pairs["m"]).to_numpy())
        return pairs.assign(shared=shared)[live]

    def others(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        return pairs.assign(shared=pairs["shared"] + overlaps(pairs, sets))

    head = F.substring("hashes", F.lit(1), F.col("n_first") * 8).alias("hashes")
    tail = F.substring("hashes", F.col("n_first") * 8 + 1, (F.col("n") - F.col("n_first")) * 8).alias("hashes")
    live = materialize(multiplied(pairs, sets, first, PAIR, head, (F.col("n") - F.col("n_first")).alias("rest")), "live")
    counted = multiplied(live, sets, others, PAIR, tail)
    is_link = F.col("shared") * 9 >= (F.col("n") + F.col("m")) * 4
    return materialize(counted.withColumn("is_link", is_link), "products")


def wide_pairs(done: DataFrame, rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wide pairs (node, n, reach, label, pivot, m, part, is_open), and the groups (pivot, m, size, open)
    of those whose pivot leaves any pair open, which is one of two components where not both have the
    pivot's label."""
    wide = with_few(done.filter("is_wide").select("node", "n", "pivot", "m", "part"), materialize(labels.join(rows.select("node", "reach"), "node"), "labels"), ["node"])
    wide = wide.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot")
    wide = materialize(wide.withColumn("is_open", F.col("label") != F.col("pivot_label")).drop("pivot_label"), "wide")
    groups = wide.groupBy("pivot", "m").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_open").alias("open"), F.min("label").alias("low"), F.max("label").alias("high"))
    return wide, materialize(groups.filter("open > 0 AND low <> high").drop("low", "high"), "open-pivots")


def in_blocks(groups: DataFrame) -> DataFrame:
    """groups with over and across, the blocks of its open and of all of its rows, and cost: the entries
    of its rows, each once a block."""
    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.lit(BLOCK_ENTRIES // 4) / F.col("m"))))
    cut = groups.withColumns({"over": F.ceil(F.col("open") / side), "across": F.ceil(F.col("size") / side)})
    return cut.withColumn("cost", F.col("m").cast("double") * (F.col("size") * F.col("over") + F.col("open") * F.col("across")))


def block_product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the left sets shares with each of the right."""
    values = np.intersect1d(_distinct(np.concatenate(left)), _distinct(np.concatenate(right)), assume_unique=True)
    shared = np.zeros((len(left), len(right)))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        known, at = _among(np.concatenate(sets), values)
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known], at[known]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    sides = [(len(sets), *cells(sets)) for sets in (left, right)]
    for low in range(0, len(values), WIDTH):
        width, dense = min(WIDTH, len(values) - low), []
        for n, row, at in sides:
            a, b = np.searchsorted(at, (low, low + width))
            dense.append(np.zeros((n, width), np.float32))
            dense[-1][row[a:b], at[a:b] - low] = 1
        shared += dense[0] @ dense[1].T
    return shared


def settled(wide: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, pivot): links that connect what is linked in the groups (of in_blocks), by the product of
    their open rows with all of their rows. A block gives a link for each two components that it joins."""
    cut = materialize(join_by_size(wide.select("node", "n", "label", "pivot", "is_open"), groups.select("pivot", "size", "over", "across"), ["pivot"], "size"), "settling")
    at = lambda seed, over: F.pmod(F.xxhash64(F.lit(seed), "node"), over)
    cell = lambda over, across, is_left: F.struct((over * F.col("across") + across).alias("block"), F.lit(is_left).alias("is_left"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda k: cell(at(0, F.col("over")), k, True))
    as_right = F.transform(F.sequence(F.lit(0), F.col("over") - 1), lambda k: cell(k, at(1, F.col("across")), False))
    cut = cut.withColumn("cell", F.explode(F.when(F.col("is_open"), F.concat(as_left, as_right)).otherwise(as_right)))
    entries = groups.agg(F.sum("cost")).first()[0] or 0
    part = F.pmod(F.xxhash64("pivot", "cell.block"), F.lit(max(1, math.ceil(entries / BLOCK_ENTRIES))))
    cut = materialize(cut.select("node", "n", "label", "pivot", "cell.block", "cell.is_left", part.alias("part")), "settling")

    def work(members: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        known = {node: np.frombuffer(h, np.uint64) for node, h in zip(sets["node"], sets["hashes"], strict=True)}
        found: list[tuple[int, int]] = []
        for _, block in members.groupby(["pivot", "block"]):
            left, right = block[block["is_left"]], block[~block["is_left"]]
            if len(left) and len(right):
                found += links(left, right, block_product([known[x] for x in left["node"]], [known[x] for x in right["node"]]))
        return pd.DataFrame(found, columns=["node", "pivot"])

    def links(left: pd.DataFrame, right: pd.DataFrame, shared: np.ndarray) -> Iterator[tuple[int, int]]:
        (a, n, x), (b, m, y) = ([side[c].to_numpy() for c in ("node", "n", "label")] for side in (left, right))
        to: dict[int, int] = {}
        for i, j in np.argwhere((9 * shared >= 4 * (n[:, None] + m)) & (x[:, None] != y)):
            one, other = x[i], y[j]
            while one in to:
                one = to[one]
            while other in to:
                other = to[other]
            if one != other:
                to[max(one, other)] = min(one, other)
                yield a[i], b[j]

    return materialize(multiplied(cut, sets_by_part(cut.select("part", "node"), rows), work, "node bigint, pivot bigint", F.col("hashes")), "settled")


def difference_cells(wide: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The cells of the next round: prefixes of the differences of the groups' wide pairs. Columns that one
    set alone has come first and, as no other row meets them, fall out; then the less common ones; those
    that the pivot has and the row lacks are last."""
    names = ["node", "n", "reach", "label", "column", "is_open"]

    def differ(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        known = {node: (np.frombuffer(h, np.uint64), np.frombuffer(o, np.uint32)) for node, h, o in zip(sets["node"], sets["hashes"], sets["often"], strict=True)}
        out = []
        for node, n, reach, label, pivot, m, is_open in zip(*(pairs[c] for c in ("node", "n", "reach", "label", "pivot", "m", "is_open")), strict=True):
            (x, often), (p, _) = known[node], known[pivot]
            both, at = _among(x, p)
            lost = np.ones(len(p), bool)
            lost[at[both]] = False
            gained = np.lexsort((x[~both], often[~both]))
            apart = np.concatenate([x[~both][gained], p[lost]])
            own = int((often[~both] == 1).sum())
            keep = apart[own : difference_prefix(len(apart), n, m, not is_open)]
            if len(keep):
                salt = _mix(np.array([pivot], np.int64).view(np.uint64))
                out.append((node, n, reach, label, is_open, _mix(keep ^ salt).view(np.int64)))
        return pd.DataFrame(out, columns=["node", "n", "reach", "label", "is_open", "columns"])

    pairs = join_by_size(wide, groups.select("pivot", "size"), ["pivot"], "size").drop("size")
    schema = "node bigint, n bigint, reach bigint, label bigint, is_open boolean, columns array<bigint>"
    cells = multiplied(pairs, sets, differ, schema, F.col("hashes"), F.col("often"))
    return cells.withColumn("column", F.explode("columns")).select(*names)


def linked_labels(rows: DataFrame) -> DataFrame:
    """(node, label): rows that links connect have one label, the least node of the component."""
    cells, labels = materialize(size_cells(rows), "cells"), rows.select("node", F.col("node").alias("label"))
    for turn in itertools.count():
        pairs = pairs_of(cells, turn)
        if pairs.isEmpty():
            return labels
        pairs = dealt(pairs)
        sets = sets_by_part(pairs.select("part", "node").union(pairs.select("part", "pivot")), rows)
        done = product(pairs, sets)
        labels = relabelled(labels, done.filter("is_link").select("node", "pivot"))
        wide, groups = wide_pairs(done, rows, labels)
        groups = materialize(in_blocks(groups), "groups")
        small, large = groups.filter(F.col("cost") <= LEFT_ENTRIES), groups.filter(F.col("cost") > LEFT_ENTRIES)
        if not small.isEmpty():
            labels = relabelled(labels, settled(wide, small, rows))
        if large.isEmpty():
            return labels
        cells = materialize(difference_cells(wide, large, sets), "cells")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (node, pivot) were added."""
    ends = links.join(labels.withColumnRenamed("label", "a"), "node").join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("b")), "pivot")
    edges = materialize(ends.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("pivot")).distinct(), "new-links")
    if edges.isEmpty():
        return labels
    merged = components(labels.sparkSession, edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges (node, pivot) reach, for every node with an edge.

    Each round every root goes to its least neighbour, twice; edges between what became one vanish.
    Labels follow the rounds' steps once, at the end."""
    edges = materialize(edges.filter("node <> pivot").distinct(), "edges")
    labels = edges.select("node").union(edges.select("pivot")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        both = edges.union(edges.select("pivot", "node"))
        least = both.groupBy("node").agg(F.min("pivot").alias("to")).withColumn("to", F.least("node", "to"))
        hop = least.alias("a").join(least.select(F.col("node").alias("n2"), F.col("to").alias("to2")), F.col("to") == F.col("n2"), "left")
        step = materialize(hop.select("node", F.coalesce("to2", "to").alias("to")), "steps")
        labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = edges.join(step.select("node", F.col("to").alias("u")), "node").join(step.select(F.col("node").alias("pivot"), F.col("to").alias("v")), "pivot")
        edges = materialize(moved.filter("u <> v").select(F.least("u", "v").alias("node"), F.greatest("u", "v").alias("pivot")).distinct(), "edges")
    return materialize(labels, "labels")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of sets_in(), and each distinct set of a doc_id: k1, k2, size (its rows), first (its
    least doc_id) and label (of its component, null without links)."""
    rows = sets_in(docs)
    known = rows.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    distinct = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("n_head").alias("n_head"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    entries = distinct.agg(F.sum("n_head")).first()[0] or 0
    heads = known.filter("head IS NOT NULL").select(F.col("k1").alias("key"), F.col("head").alias("hashes"))
    counts = shared_counts(heads, entries, HEAD).select(F.col("key").alias("k1"), "shared")
    left = distinct.join(counts, "k1", "left").filter(F.col("n_head") - F.coalesce("shared", F.lit(0)) < prefix_of(F.col("n")))
    left = materialize(left.select(F.col("id").alias("node"), "first", "k1", "k2"), "left")
    repeats = not known.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").isEmpty()
    matrix = materialize(with_commonness(materialize(sets_of(docs, left, repeats), "sets")), "matrix")
    labels = linked_labels(matrix)
    labels = labels.join(matrix.select("node", "id"), "node").select("id", "label")
    return rows, distinct.join(labels, "id", "left").select("k1", "k2", "size", "first", "label")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows, grouped = labelled(docs)
    grouped = materialize(grouped.filter("size > 1 OR label IS NOT NULL"), "groups")
    least = grouped.groupBy("label").agg(F.min("first").alias("least")).filter("label IS NOT NULL")
    of_set = grouped.join(least, "label", "left").select("k1", "k2", "size", F.coalesce("least", "first").alias("component"))
    found = join_by_size(rows.select("doc_id", "n", "k1", "k2"), materialize(of_set, "components"), ["k1", "k2"], "size", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def with_set_key(docs: DataFrame) -> DataFrame:
    """docs with _k1 and _k2, the key of the row's shingles (null if it has none)."""
    keyed = with_row_key(docs)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [_set_key(h) if len(h) else (None, None) for h in shingle_sets(batch.text)]
            yield batch[list(ROW_KEY)].assign(_k1=pd.array([a for a, _ in keys], "Int64"), _k2=pd.array([b for _, b in keys], "Int64"))

    digests = pick(keyed, "text", *ROW_KEY).mapInPandas(giving_back(make), ", ".join(f"{k} bigint" for k in (*ROW_KEY, "_k1", "_k2"))).distinct()
    return keyed.join(digests, list(ROW_KEY)).select(*docs.columns, "_k1", "_k2")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays, one with the least doc_id. Rows of one doc_id are judged each
    by its own text; of those with equal shingles, or none, one stays. Rows with a null doc_id all stay."""
    rows, grouped = labelled(docs)
    grouped = materialize(grouped.filter("size > 1 OR label IS NOT NULL"), "groups")
    keepers = grouped.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("first", "k1", "k2")).alias("keeper"))
    is_keeper = F.coalesce(F.col("keeper") == F.struct("first", "k1", "k2"), F.lit(True))
    judged = materialize(grouped.join(keepers, "label", "left").select("k1", "k2", "size", "first", is_keeper.alias("is_keeper")), "keepers")
    found = join_by_size(rows.filter("doc_id IS NOT NULL").select("doc_id", "k1", "k2"), judged, ["k1", "k2"], "size", "left")
    stays = F.col("first").isNull() | (F.col("is_keeper") & (F.col("doc_id") == F.col("first")))
    found = materialize(found.select("doc_id", "k1", "k2", stays.alias("stays")), "joined")
    by_id = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("stays")), "by-id")
    kept = among(docs, by_id.filter("NOT stays").select("doc_id"), "left_anti")
    repeated = materialize(by_id.filter("n > 1 AND stays").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    several = with_set_key(among(kept, repeated, "left_semi"))
    good = found.filter("stays").select(F.col("doc_id").alias("_id"), F.col("k1").alias("_good1"), F.col("k2").alias("_good2")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & F.col("_k1").eqNullSafe(F.col("_good1")) & F.col("_k2").eqNullSafe(F.col("_good2"))
    several = several.join(good, same, "left_semi").dropDuplicates(["doc_id", "_k1", "_k2"]).select(*docs.columns)
    return among(kept, repeated, "left_anti").unionByName(several)
