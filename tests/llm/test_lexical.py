"""Ranked lexical search against a plain scorer."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lexical
from palimpsest.llm.common import ship

TERM = re.compile(lexical.TERM)


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, items, k=20):
    cut = [(i, d, Counter(terms(t))) for i, (d, t) in enumerate(docs)]
    cut = [x for x in cut if x[2]]
    n_docs, total = len(cut), sum(sum(c.values()) for _, _, c in cut)
    df = Counter(t for _, _, c in cut for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, Counter()).update(terms(text))
    out = set()
    for item, own in wanted.items():
        scores = []
        for row, d, c in cut:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in own.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d, row))
        out |= {(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k])}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def corpus(n=400, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(300)]
    pick = lambda size: " ".join(words[min(299, int(x))] for x in rng.exponential(40, size))
    docs = [(int(i), pick(int(rng.integers(1, 120)))) for i in rng.permutation(n)]
    return docs, [(i, pick(int(rng.integers(1, 40)))) for i in range(25)]


@pytest.mark.parametrize("seed_postings", [1, 60, 10**9])
def test_plain_scores(spark, monkeypatch, seed_postings):
    """However many postings the lower bound is taken from."""
    monkeypatch.setattr(lexical, "SEED_POSTINGS", seed_postings)
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in lexical.rank(d.repartition(4), i).collect()} == plain(docs, items)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_BROADCAST", 3)
    docs, items = corpus(120)
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in lexical.rank(d.repartition(4), i, 5).collect()} == plain(docs, items, 5)


def test_candidates_are_fewer_than_matches(spark, monkeypatch):
    """The bound keeps most matches of common terms out of the sums."""
    seen = []
    real = lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df, name: (seen.append((name, real(df, name))), seen[-1][1])[1])
    docs, items = corpus(1500)
    d, i = frames(spark, docs, [(0, "t1 t2 t250 t251"), (1, "t0 t3 t299")])
    lexical.rank(d, i).count()
    counts = {name: df.count() for name, df in seen}
    matching = sum(1 for _, t in docs for own in ({"t1", "t2", "t250", "t251"}, {"t0", "t3", "t299"}) if own & set(t.split(" ")))
    assert counts["candidates"] < matching / 3


def test_an_index_of_all_terms(spark):
    docs, items = corpus(150)
    d, i = frames(spark, docs, items)
    index, n, total = lexical.postings(d)
    assert index.count() == sum(len(set(t.split(" "))) for _, t in docs)
    got = lexical.search(index, n, total, lexical.item_terms(i), 7)
    assert {tuple(r) for r in got.collect()} == plain(docs, items, 7)


def test_edge_cases(spark):
    docs = [(3, "Éa b-c"), (1, "Éa b-c"), (2, None), (4, ""), (5, "... !"), (None, "Éa b-c"), (3, "Éa b-c"), (6, "x " * 60_000 + "éa B c")]
    docs += [(7, "你好"), (8, "a_b 1\x002")]
    items = [(1, "b c éa"), (1, "B"), (None, "b"), (2, None), (3, "zzz"), (4, "你好"), (5, "1 2 x x x"), (6, "")]
    d, i = frames(spark, docs, items)
    extra = d.withColumns({c: F.lit(9) for c in ("row", "term", "n", "tf", "bucket", "score", "rank")})
    got = lexical.rank(extra, i.withColumns({c: F.lit("q") for c in ("term", "k", "doc_id")}))
    assert {tuple(r) for r in got.collect()} == plain(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    for a, b in (([], items), (docs, []), ([(1, None)], items)):
        d, i = frames(spark, a, b)
        assert lexical.rank(d, i).collect() == []
