"""Collocations against a plain count."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import collocations
from palimpsest.llm.common import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def pieces(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def plain(rows, longest=3, least=10, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode("utf-8"), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.add((lang, rank + 1, phrase.decode("utf-8"), -a, left, right, n[lang], -score))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string")
    df = df.withColumns({c: F.lit(1) for c in ("phrase", "size", "f", "n", "words", "rank", "score", "block")})
    return {tuple(r) for r in collocations.mine(df.repartition(3), **options).collect()}


def corpus(seed=4, n=200, words=30):
    rng = np.random.default_rng(seed)
    made = lambda: "".join(str(w) + (". " if rng.random() < 0.1 else " ") for w in (f"V{min(words, int(x))}" for x in rng.exponential(8, 50)))
    return [(made(), ("en", "de", None)[int(rng.integers(0, 3))]) for _ in range(n)]


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_plain_counts(spark, longest):
    rows = corpus()
    assert found(spark, rows, longest=longest) == plain(rows, longest)


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 70)
    monkeypatch.setattr(collocations, "BLOCK_KEYS", 500)
    rows = corpus(9)
    assert found(spark, rows, top=15) == plain(rows, top=15)


def test_a_full_filter_loses_and_adds_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_FILTER_BITS", 4)
    monkeypatch.setattr(collocations, "BLOCK_KEYS", 10**9)
    rows = corpus(11)
    assert found(spark, rows) == plain(rows)


def test_edge_cases(spark):
    rows = [(None, "en"), ("", None), ("a b " * 30, None), ("É e\x0bÉ e\tÉ  e\x0c" * 6, "fr"), ("x", "de"), (" .,;\n", "de"), ("\x00 你 " * 12, "zh")]
    rows += [("same same same", "q")] * 11
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == set()


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 3_000_000_000_000), ("en", "a", 1, 3_000_000_000_001), ("en", "b", 1, 9_000_000_000_000)], "lang string, phrase string, size int, f bigint")
    row = collocations.scored(phrases).first()
    assert row["score"] == 1000000 * 3_000_000_000_000**2 // (3_000_000_000_001 * 9_000_000_000_000)


def test_one_very_long_piece(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 1000)
    rows = [("u v w " * 5000 + ". u v", "en")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_suffix_array(depth):
    ids = np.random.default_rng(depth).integers(0, 3, 200)
    order = collocations.suffix_array(ids, depth)
    first = [tuple(ids[i : i + depth]) for i in order]
    assert first == sorted(first) and sorted(order) == list(range(200))
