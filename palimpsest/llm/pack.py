"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens, by a
grouping genetic algorithm on islands.

Every document becomes pieces: only documents longer than the capacity are cut, into full pieces
and one shorter last piece. Full pieces are sequences of their own. The others are dealt by hash
into blocks of about `BLOCK` pieces. Several islands work on each block: a population of packings
starts from best fits of the pieces in shuffled orders; crossover takes whole well-filled bins of one
parent into the other, drops the bins there that hold the same pieces, and puts the displaced
pieces back by best fit; fitness is the number of bins, then the sum of squared fills, which drives
what room is left into few bins. Between epochs each island sends its best packing to the next (elite
migration, by a Spark shuffle). An island stops early only when all its bins but one are full. Bins
left badly filled in the best packings are then packed again across blocks, in groups of about
`BLOCK` pieces, starting from what they were, so no pass can make it worse.

Tokens come from the given tokenizer file. Its normalisation (NFC, white space, lower case) is
applied here, and each distinct word between white space is encoded once per worker and stage (its pieces
never cross white space); texts in which that could differ (control characters that only Python
takes for white space, a capital sigma, the file's special tokens) are encoded whole.

Edge cases: null and empty texts are one piece of the end id alone. Repeated rows are packed as
documents of their own. A null doc_id is carried as null. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_kept, giving_back, kept, materialize, pick

CAPACITY = 4096
END_ID = 1
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
#: Packings on an island, and crossovers there in an epoch.
POPULATION, GENERATIONS = 4, 8
#: Bins with more free tokens than this share of the capacity are packed again across blocks.
SLACK = 1 / 64
#: A worker forgets what it has learned beyond so many words (about 400 bytes each).
MAX_CACHED_WORDS = 600_000
#: Marks that end a word.
MARKS = ".,;:!?"
#: In texts with these the parts of a text could depend on each other.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ")
PIECE = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Words(dict):
    """Numbers words as they come, and keeps the new ones aside."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Token ids of texts, equal to those of the tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"].lower() for t in parts["added_tokens"]]
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))
        self.reset()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process and stage: what it has learned serves later tasks of the stage."""
        return kept((cls, path), lambda: cls(path))

    @cached_property
    def whole(self):
        """The tokenizer as it is, for the few texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reset(self) -> None:
        """Forget all words. A word is a stem and a mark behind it, both numbered among the stems;
        number 0 is the empty one."""
        self.words, self.stems = _Words(), _Words()
        self.word_parts = np.zeros((0, 2), np.int32)
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for mark in ("", *MARKS):
            self.stems[mark]
        self._learn_stems()

    def _learn_stems(self) -> None:
        new, self.stems.new = self.stems.new, []
        ids = [e.ids for e in self.bare.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def learn(self) -> None:
        """Encode what was seen since the last call. A mark behind letters is a piece of its own."""
        new, self.words.new = self.words.new, []
        if new:
            number, none = self.stems.__getitem__, 0
            parts = [(number(w[:-1]), number(w[-1])) if w[-1] in MARKS and w[:-1].isalpha() else (number(w), none) for w in new]
            self._learn_stems()
            self.word_parts = np.concatenate([self.word_parts, np.array(parts, np.int32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > MAX_CACHED_WORDS:
            self.reset()
        number, coded = self.words.__getitem__, []
        for text in texts:
            lowered = (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()
            if any(c in text for c in ODD) or ("<|" in lowered and any(s in lowered for s in self.special)):
                coded.append(self.whole.encode(text, add_special_tokens=False).ids)
            else:
                words = lowered.split()
                coded.append(np.fromiter(map(number, words), np.int32, len(words)))
        self.learn()
        out = []
        for code in coded:
            if isinstance(code, list):
                out.append(np.array(code, np.uint32))
                continue
            parts = self.word_parts[code].ravel()
            sizes = self.sizes[parts]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[parts] - (ends - sizes), sizes)
            out.append(self.flat[at])
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECE rows of every document, with an identifier of their own (uid)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, uid = WordEncoder.of(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.iloc[at : at + 256], []
                for doc_id, ids in zip(part.doc_id, encoder.encode([t or "" for t in part.text]), strict=True):
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    data = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(data), capacity)):
                        own = data[start : start + capacity]
                        rows.append((uid, doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
                        uid += 1
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"doc_id": "Int64"})

    return pick(docs, "doc_id", "text").mapInPandas(giving_back(cut), PIECE)


Bins = list[list[int]]


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Each piece goes where it leaves the least room; into a new bin where it fits nowhere."""
    bins = [list(b) for b in bins or []]
    rooms = sorted((capacity - sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    for i in order:
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, n = rooms.pop(at)
            bins[n].append(i)
            insort(rooms, (room - sizes[i], n))
    return bins


def fitness(bins: Bins, sizes: list[int]) -> tuple[int, int]:
    return len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def crossover(giver: Bins, taker: Bins, sizes: list[int], capacity: int, r: random.Random) -> Bins:
    """Whole well-filled bins of giver go into taker; bins of taker with the same pieces are
    dissolved, and what they held besides is put back by best fit, longest first."""
    full = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    chosen = [b for b in full[: max(1, (2 * len(full)) // 3)] if r.random() < 0.6] or full[:1]
    taken = {i for b in chosen for i in b}
    kept = [b for b in taker if taken.isdisjoint(b)]
    displaced = [i for b in taker if not taken.isdisjoint(b) for i in b if i not in taken]
    #: The emptiest kept bins are dissolved too, or best fit would have nothing to move.
    kept.sort(key=lambda b: -sum(sizes[i] for i in b))
    spare = max(1, len(kept) // 20) if kept else 0
    displaced += [i for b in kept[len(kept) - spare :] for i in b]
    return best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), capacity, chosen + kept[: len(kept) - spare])


def is_perfect(bins: Bins, sizes: list[int], capacity: int) -> bool:
    """All bins but one are full: no packing is fitter."""
    full, rest = divmod(sum(sizes), capacity)
    return fitness(bins, sizes) == (full + (rest > 0), -(full * capacity**2 + rest**2))


def evolve(sizes: list[int], capacity: int, start: list[Bins], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The fittest packing after so many crossovers; it stops before only where none can be fitter.
    Those who are not given are best fits of shuffled pieces, not of sorted ones, which are all alike."""
    r = random.Random(seed)
    order, people = list(range(len(sizes))), list(start)
    while len(people) < population:
        r.shuffle(order)
        people.append(best_fit(sizes, order, capacity))
    people = sorted(((fitness(p, sizes), n, p) for n, p in enumerate(people)), key=lambda x: x[:2])
    for n in range(len(people), len(people) + generations):
        if len(people) < 2 or is_perfect(people[0][2], sizes, capacity):
            break
        giver, taker = r.sample(people, 2)
        child = crossover(giver[2], taker[2], sizes, capacity, r)
        fit = fitness(child, sizes)
        if fit not in [p[0] for p in people]:
            insort(people, (fit, n, child), key=lambda x: x[:2])
            del people[population:]
    return people[0][2]


def _bins_of(numbers: pd.Series) -> Bins:
    out: dict[int, list[int]] = {}
    for i, n in enumerate(numbers):
        out.setdefault(n, []).append(i)
    return list(out.values())


def _evolved(frame: pd.DataFrame, start: list[Bins], seed: int, capacity: int) -> pd.DataFrame:
    drop_kept()
    sizes = frame.length.tolist()
    best = evolve(sizes, capacity, start, seed)
    bins, fill, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for n, members in enumerate(best):
        at = 0
        for i in sorted(members):
            bins[i], offset[i] = n, at
            at += sizes[i]
        fill[members] = at
    return frame.assign(bin=bins, fill=fill, offset=offset, n_bins=len(best))


PACKED = "block bigint, island int, uid bigint, length bigint, bin bigint, fill bigint, offset bigint, n_bins bigint"


def _continuation(epoch: int, capacity: int):
    def go_on(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [p.sort_values("uid").reset_index(drop=True) for _, p in frame.groupby("source")]
        seed = (epoch << 48) + int(frame.block.iloc[0]) * ISLANDS + int(frame.island.iloc[0])
        done = _evolved(parts[0], [_bins_of(p.bin) for p in parts], seed, capacity)
        return done[[c.split()[0] for c in PACKED.split(", ")]]

    return go_on


def pack_blocks(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (block, uid, length, and prior: a bin number or null) with bin, fill and offset from the
    best island of each block."""
    dealt = rows.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid").reset_index(drop=True)
        start = [] if frame.prior.isna().any() else [_bins_of(frame.prior)]
        done = _evolved(frame, start, int(frame.block[0]) * ISLANDS + int(frame.island[0]), capacity)
        return done[[c.split()[0] for c in PACKED.split(", ")]]

    best = dealt.groupBy("block", "island").applyInPandas(begin, PACKED)
    for epoch in range(1, EPOCHS):
        # An island keeps its own elite and receives its neighbour's.
        elites = materialize(best, "elites").withColumn("source", F.col("island"))
        moved = elites.withColumn("island", F.explode(F.array(F.col("source"), (F.col("source") + 1) % ISLANDS)))

        best = moved.groupBy("block", "island").applyInPandas(_continuation(epoch, capacity), PACKED)
    best = materialize(best, "evolved")
    winner = best.groupBy("block").agg(F.min(F.struct("n_bins", "island")).alias("w")).select("block", F.col("w.island").alias("island"))
    return best.join(winner, ["block", "island"]).select("block", "uid", "length", "bin", "fill", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    all_pieces = materialize(pieces(docs, tokenizer_path, capacity), "pieces")
    full = F.col("length") >= capacity
    n = all_pieces.filter(~full).count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    rows = all_pieces.filter(~full).select(block.alias("block"), "uid", "length", F.lit(None).cast("long").alias("prior"))
    packed = materialize(pack_blocks(rows, capacity), "packed")
    placed = packed.select("uid", (F.shiftleft("block", 20) + F.col("bin") + 1).alias("sequence_id"), "fill", "offset")
    if blocks > 1:
        loose = placed.filter(F.col("fill") < int(capacity * (1 - SLACK)))
        n_loose = loose.count()
        groups = max(1, -(-n_loose // BLOCK))
        if n_loose:
            again = loose.join(all_pieces.select("uid", "length"), "uid").select(
                F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("block"), "uid", "length", F.col("sequence_id").alias("prior")
            )
            redone = pack_blocks(again, capacity).select("uid", (F.shiftleft(F.col("block") + blocks, 20) + F.col("bin") + 1).alias("sequence_id"), "fill", "offset")
            placed = placed.filter(F.col("fill") >= int(capacity * (1 - SLACK))).unionByName(redone)
    whole = all_pieces.filter(full).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = placed.select("uid", "sequence_id", "offset").unionByName(whole)
    return all_pieces.join(places, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
