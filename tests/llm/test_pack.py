"""Best-fit packing: an exact round trip to the tokens, and the bounds of any packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import pack
from palimpsest.llm.registry import tokenizer_path

SCHEMA = "doc_id bigint, text string"
ENCODER = pack.WordEncoder(tokenizer_path())
WHOLE = Tokenizer.from_file(tokenizer_path())


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_tokenizer(text):
    assert ENCODER.encode([text])[0].tolist() == whole(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "don't we'll I'VE", "<|endoftext|> x <|STARTOFTEXT|>", "ΑΣ ΣΑΣ σς", "é é ﬁ İstanbul", "a\x1cb\x85c d", "12,345.67!?...", "word.Word,word:::", "日本語。テキスト!", "a" * 5000, "🙂🙂 👩‍👩‍👧", "؀ّ,", "x'S 's"],
)
def test_encoder_on_odd_texts(text):
    assert ENCODER.encode([text, "between", text])[2].tolist() == whole(text)


def test_encoder_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, ENCODER.encode(texts), strict=True):
        assert ids.tolist() == whole(text)


def check(rows, found, capacity):
    """Every token of every document once, pieces cut only at the capacity, sequences gapless."""
    wanted = defaultdict(int)
    for doc_id, text in rows:
        data = np.array([*whole(text or ""), 1], "<u4")
        for piece, start in enumerate(range(0, len(data), capacity)):
            own = data[start : start + capacity]
            wanted[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(n for parts in sequences.values() for _, n in parts) // capacity)


def test_round_trip_and_bound_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    used, bound = check(rows, pack.pack(docs, tokenizer_path()).collect(), pack.CAPACITY)
    assert used <= bound + 1


def test_many_blocks_are_repacked_across(spark, monkeypatch):
    monkeypatch.setattr(pack, "BLOCK", 40)
    r = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(r.choice((3, 9, 20, 31, 40, 63, 64, 65, 130))))) for i in range(300)]
    used, bound = check(rows, pack.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), 64).collect(), 64)
    assert used <= bound * 1.08 + 1


def test_edge_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "null id"), (3, "long " * 9000), (4, "tie"), (5, "tie")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", sequence_id int")
    check(rows, pack.pack(docs, tokenizer_path()).collect(), pack.CAPACITY)
    assert pack.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).collect() == []


def test_crossover_keeps_every_piece_once_and_fits():
    r = random.Random(8)
    for _ in range(200):
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 40))]
        order = list(range(len(sizes)))
        parents = [pack.best_fit(sizes, r.sample(order, len(order)), 64) for _ in range(2)]
        child = pack.crossover(*parents, sizes, 64, r)
        assert sorted(i for b in child for i in b) == order
        assert all(sum(sizes[i] for i in b) <= 64 for b in child)


def triplets(n, capacity, seed):
    """Pieces of a packing without any room: three to a bin, each above a quarter of it."""
    r, sizes = random.Random(seed), []
    for _ in range(n):
        first = r.randint(38 * capacity // 100, 49 * capacity // 100)
        second = r.randint(capacity // 4, (capacity - first) // 2)
        sizes += [first, second, capacity - first - second]
    r.shuffle(sizes)
    return sizes


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_crossover_finds_what_best_fit_misses(seed):
    """20 bins are enough; best fit of sorted pieces and the whole starting population need more than
    evolution does."""
    sizes = triplets(20, 1000, seed)
    order = list(range(60))
    falling = len(pack.best_fit(sizes, sorted(order, key=lambda i: -sizes[i]), 1000))
    start = pack.evolve(sizes, 1000, [], seed, population=20, generations=0)
    best = pack.evolve(sizes, 1000, [], seed, population=20, generations=1500)
    assert sorted(i for b in best for i in b) == order and all(sum(sizes[i] for i in b) <= 1000 for b in best)
    assert 20 <= len(best) < min(len(start), falling)


def test_crossover_gathers_the_room_that_is_left():
    r = random.Random(6)
    sizes = [min(4095, max(1, int(r.lognormvariate(5.5, 1.2)))) for _ in range(1500)]
    start, best = (pack.evolve(sizes, 4096, [], 1, generations=n) for n in (0, pack.GENERATIONS))
    assert pack.fitness(best, sizes) < pack.fitness(start, sizes) and len(best) <= len(start)
    assert not pack.is_perfect(start, sizes, 4096)


def test_evolution_stops_at_a_perfect_packing():
    assert pack.is_perfect([[0, 1], [2]], [30, 34, 5], 64) and not pack.is_perfect([[0], [1], [2]], [30, 34, 5], 64)
    assert pack.evolve([30, 34, 5], 64, [[[0, 1], [2]]], 1) == [[0, 1], [2]]
