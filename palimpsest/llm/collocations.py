"""Phrase collocations: phrases of two and more words whose words come together more often than apart,
by suffix arrays of word ids.

1. A task cuts texts into pieces and words and numbers the words. Over some `SHARD_WORDS` words of one
   language it builds the suffix array by prefix doubling (ranks of 1, 2, 4 ... words, until they are
   as long as the longest phrase). Neighbours in it share a prefix of words (LCP); a run of suffixes
   with an LCP of k or more is an interval, and its length is the count of a phrase of k words.
2. Counts are merged globally in two passes. The first sends 64-bit keys of phrases with their counts,
   packed by blocks of the key's range, and leaves a filter of the keys that reach `min_count`. Two
   phrases of one key can only make a count too high, so the filter loses none. The second pass sends
   the phrases themselves, of those that the filter lets through, and merges them by language and
   phrase: these counts are exact.
3. A phrase's parts are at least as frequent as the phrase, so they are among the merged phrases. Cuts
   are scored by joins; phrases within a longer one that is nearly as frequent are dropped.

The filter has at most `2**MAX_FILTER_BITS` bits (16 MB), whatever the input; where it is full it lets
more phrases through, which costs shuffle and no result. A very frequent phrase is one entry a shard.

Edge cases: a null text is empty, a null lang `und`. Empty tables give an empty result. Repeated rows
count each time. Ties are broken by count, then by the phrase's bytes. Phrases don't cross pieces or
texts. Extra columns are ignored, whatever their names. A long text is spread over several shards, which
end where a piece ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, pick

#: Words of one language that one suffix array holds, about.
SHARD_WORDS = 250_000
#: Keys of a block in the first pass, about (9 to 12 bytes each, some copies of them in a task).
BLOCK_KEYS = 1_000_000
MAX_FILTER_BITS = 27
#: The phrases of a language that the report has.
TOP = 2_000
#: Shares of a language that are ranked on their own first.
SHARES = 16

_TABLE = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x0A
_TABLE = bytes(_TABLE)
#: Between pieces: a byte that UTF-8 never has.
_BREAK = b"\xff"
_PLACES = np.random.default_rng(20250611).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """The words of a text in order, with _BREAK after each piece."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \xff ")
    return [*data.split(), _BREAK]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids in the order of the suffixes that begin there, by their first `depth` ids at least."""
    rank, length = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while length < depth:
        later = np.zeros_like(rank)
        later[: max(0, len(rank) - length)] = rank[length:] + 1
        both = rank * (len(rank) + 1) + later
        order = np.argsort(both, kind="stable")
        step = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])]) if len(order) else order
        rank = np.empty_like(rank)
        rank[order] = step
        length *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, how many words it shares with the one before (at most depth, within its piece)."""
    lcp = np.zeros(len(order), np.int64)
    alive = np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        alive = alive & (room[a] > k) & (room[b] > k)
        alive[alive] = ids[a[alive] + k] == ids[b[alive] + k]
        lcp[1:] += alive
    return lcp


def intervals(words: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (length, starts, counts, ids, vocabulary), where starts are places of ids at which
    the distinct phrases of that length begin, and counts how often each occurs."""
    ids, vocabulary = pd.factorize(np.array(words, dtype=object))
    # Words from each place to the end of its piece.
    places = np.arange(len(ids))
    ends = np.flatnonzero(ids == np.flatnonzero(vocabulary == _BREAK)[0])
    room = ends[np.searchsorted(ends, places)] - places
    order = suffix_array(ids, longest)
    lcp = common_prefixes(ids, order, room, longest)
    for k in range(1, longest + 1):
        # Suffixes that are too short break runs too, as no neighbour shares k words with them.
        begins = np.flatnonzero(lcp < k)
        counts = np.diff(np.append(begins, len(order)))
        whole = room[order[begins]] >= k
        yield k, order[begins[whole]], counts[whole], ids, vocabulary


def phrase_keys(starts: np.ndarray, k: int, ids: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
    """64-bit keys of the phrases of k words at starts."""
    key = np.full(len(starts), xxhash.xxh3_64_intdigest(f"{k}:{lang}".encode()), np.uint64)
    for j in range(k):
        key += _PLACES[j % 64] * hashes[ids[starts + j]]
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _shards(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of SHARD_WORDS words about, each ending with a break."""
    held: dict[str, list[bytes]] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words = held.setdefault(lang, [])
            words += words_of(text)
            while len(words) > SHARD_WORDS:
                # At the last break within the shard, or else the first after it.
                end = next((i + 1 for i in range(SHARD_WORDS - 1, -1, -1) if words[i] == _BREAK), 0)
                end = end or words.index(_BREAK) + 1
                yield lang, words[:end]
                del words[:end]
        while sum(map(len, held.values())) > 2 * SHARD_WORDS:
            lang = max(held, key=lambda k: len(held[k]))
            yield lang, held.pop(lang)
    for lang, words in held.items():
        if words:
            yield lang, words


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "text", "lang").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def frequent_filter(docs: DataFrame, longest: int, min_count: int) -> tuple[int, np.ndarray]:
    """(bits, filter): a bit for each value of the first `bits` bits of a phrase key, set where a key reaches
    min_count."""
    texts = _texts(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    # Words have some six characters; each place begins a phrase of each length.
    keys = max(1, chars * longest // 6)
    block_bits = min(30, max(0, math.ceil(math.log2(keys / BLOCK_KEYS))))
    bits = min(MAX_FILTER_BITS, max(16, block_bits + 3, math.ceil(math.log2(keys))))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words in _shards(batches, longest):
            parts, sizes = [], []
            for k, starts, counts, ids, vocabulary in intervals(words, longest):
                if k == 1:
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
                parts.append(phrase_keys(starts, k, ids, hashes, lang))
                sizes.append(counts)
            key, count = np.concatenate(parts), np.minimum(np.concatenate(sizes), min_count).astype(np.uint16)
            order = np.argsort(key)
            key, count = key[order], count[order]
            block = (key >> np.uint64(32) >> np.uint64(32 - block_bits)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            runs = zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True) if len(at) else ()
            rows = [(int(block[a]), key[a:b].tobytes(), count[a:b].tobytes()) for a, b in runs]
            yield pd.DataFrame(rows, columns=["block", "keys", "counts"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["keys"]])
        count = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["counts"]]).astype(np.int64)
        order = np.argsort(key)
        key, count = key[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        good = key[at][np.add.reduceat(count, at) >= min_count] if len(at) else key
        block = int(frame["block"].iloc[0])
        own = np.zeros(1 << (bits - block_bits), bool)
        own[((good >> np.uint64(64 - bits)) & np.uint64((1 << (bits - block_bits)) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"block": [block], "bits": [np.packbits(own).tobytes()]})

    packed = texts.select("lang", "text").mapInPandas(local, "block bigint, keys binary, counts binary")
    found = packed.groupBy("block").applyInPandas(merge, "block bigint, bits binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - block_bits - 3)
    # The blocks' bits: 2**MAX_FILTER_BITS in all, at most.
    for block, own in found.collect():
        whole[block * width : (block + 1) * width] = np.frombuffer(own, np.uint8)
    return bits, whole


def phrase_counts(docs: DataFrame, longest: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of each phrase of 1 to longest words that occurs min_count times or more, and
    (lang, n)."""
    bits, whole = frequent_filter(docs, longest, min_count)
    known = docs.sparkSession.sparkContext.broadcast(whole)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words in _shards(batches, longest):
            for k, starts, counts, ids, vocabulary in intervals(words, longest):
                if k == 1:
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
                    # All words of the shard, as a phrase of none.
                    yield pd.DataFrame({"lang": [lang], "phrase": [""], "size": [0], "f": [int(counts.sum())]})
                place = phrase_keys(starts, k, ids, hashes, lang) >> np.uint64(64 - bits)
                good = (known.value[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0
                starts, counts = starts[good], counts[good]
                for a in range(0, len(starts), 50_000):
                    cells = vocabulary[ids[starts[a : a + 50_000, None] + np.arange(k)]]
                    phrases = [b" ".join(row).decode("utf-8", "surrogatepass") for row in cells.tolist()]
                    yield pd.DataFrame({"lang": lang, "phrase": phrases, "size": k, "f": counts[a : a + 50_000]})

    found = _texts(docs).select("lang", "text").mapInPandas(local, "lang string, phrase string, size int, f bigint")
    merged = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("size") == 0))
    merged = materialize(merged, "phrases")
    return merged.filter("size > 0"), merged.filter("size = 0").select("lang", F.col("f").alias("n"))


def _part(low: Column, high: Column) -> Column:
    """Words low to high of the phrase, from 1."""
    return F.array_join(F.slice("words", low, high - low + 1), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, size, a, l, r, score of each phrase of two and more words, by its lowest-scoring cut."""
    rows = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("*", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size")).alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # Products in 38 digits.
    d = lambda c: f"cast({c} AS decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(cast({d('a')} * {d('a')} AS decimal(32,0)) * 1000000 AS decimal(38,0)) div ({d('l')} * {d('r')})"))
    lowest = F.min_by(F.struct("words", "size", "a", "l", "r", "score"), F.struct("score", "k")).alias("cut")
    return cuts.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "cut.*")


def without_contained(candidates: DataFrame) -> DataFrame:
    """Candidates whose words lie within no longer candidate with 100 * f(longer) >= 50 * a."""
    longer = candidates.filter("size > 2").select("lang", "words", "size", "a")
    spans = longer.withColumn("inner_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    spans = spans.withColumn("low", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner_size") + 1)))
    inner = spans.select("lang", _part(F.col("low"), F.col("low") + F.col("inner_size") - 1).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(100 * F.col("longer_a") < 50 * F.col("a"), F.lit(True))).drop("longer_a")


def mine(docs: DataFrame, longest: int = 3, min_count: int = 10, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words."""
    phrases, totals = phrase_counts(docs, longest, min_count)
    candidates = materialize(scored(phrases), "collocations")
    kept = without_contained(candidates).select("lang", "phrase", "a", "l", "r", "score")
    # A language is ranked in shares first, so the last window holds `top` phrases of each share at most.
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*best_first)
    kept = kept.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
