"""n-gram Jaccard join against all pairs in plain Python."""

import random
import re

import pytest

from palimpsest.llm import common, ngram_join

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=220):
    """Copies, chains of edits, texts that share a long frame, and texts at the very threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda k: [r.choice(vocabulary) for _ in range(k)]
    frame, texts = fresh(45), []
    while len(texts) < n:
        kind = r.random()
        if kind < 0.3 or not texts:
            texts.append(fresh(r.choice((1, 3, 5, 6, 9, 30, 60, 120))))
        elif kind < 0.4:
            texts.append(list(r.choice(texts)))
        elif kind < 0.6:
            texts.append(frame + fresh(r.choice((1, 3, 6, 9, 11, 12, 14))))
        elif kind < 0.7:
            base = fresh(5)
            texts += [base + ["end"], base + ["end", "end2"], [*base, "other"]]
        else:
            copy = list(r.choice(texts))
            for _ in range(r.choice((1, 1, 2, 3))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    return [(i, " ".join(t).upper() if r.random() < 0.1 else r.choice((" ", "\n", " \t")).join(t)) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"BLOCK_ENTRIES": 500, "TASK_ENTRIES": 100}), (3, {"MEMBERS": 2, "FREQUENT_ROWS": 3, "HOT_ROWS": 3}), (4, {"MAX_BROADCAST_IDS": 1})])
def test_same_components_as_all_pairs(spark, monkeypatch, seed, sizes):
    """Also with blocks, parts and hot keys of a few rows, as a large table has them."""
    for name, value in sizes.items():
        monkeypatch.setattr(common if name == "HOT_ROWS" else ngram_join, name, value)
    rows = corpus(seed)
    assert {tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)


def thue_morse(first, length):
    word = first
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_long_words_of_one_structure_stay_apart(spark):
    """Words that are equal under any polynomial hash modulo 2^64."""
    rows = [(1, thue_morse("a", 1024)), (2, thue_morse("b", 1024)), (3, thue_morse("a", 1024)), (4, "x" * 70_000), (5, "x" * 70_001)]
    assert {tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)


def test_long_texts_are_cut_at_gaps_only(monkeypatch):
    text = " ".join(f"Word{i}" + "\t" * (i % 3) for i in range(500)) + " end"
    whole = ngram_join.shingle_set(text)
    monkeypatch.setattr(ngram_join, "PIECE", 7)
    assert (ngram_join.shingle_set(text) == whole).all()


def test_blocks_left_open_round_after_round(spark):
    """Texts around one frame with parts shared by some of them: no pivot is linked to most."""
    r = random.Random(21)
    frame = [f"f{i}" for i in range(60)]
    rests = [[f"r{k}_{i}" for i in range(4)] for k in range(6)]
    rows = []
    for i in range(160):
        own = [w for k in sorted(r.sample(range(6), 2)) for w in rests[k]] + [f"own{i}"] * r.randrange(3)
        rows.append((i, " ".join(frame[: r.choice((44, 52, 60))] + own)))
    assert {tuple(x) for x in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)


def test_many_texts_around_one_passage(spark):
    """A hot group: every text holds the same passage, and most are linked through some others."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{r.randrange(30)}" for _ in range(r.randrange(9))), *passage, *(f"b{r.randrange(30)}" for _ in range(r.randrange(9)))])) for i in range(300)]
    assert {tuple(x) for x in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)


@pytest.mark.parametrize("sizes, most", [({}, 1), ({"SIDE": 7, "WIDTH": 5}, 1), ({"LEFT_ENTRIES": 0}, 40)])
def test_near_texts_that_are_not_linked_are_settled_at_once(spark, monkeypatch, sizes, most):
    """Texts around one frame of which few are linked: a round, and not one for every few pivots; also by
    differences alone, as larger groups are."""
    for name, value in sizes.items():
        monkeypatch.setattr(ngram_join, name, value)
    turns, pairs_of = [], ngram_join.pairs_of
    monkeypatch.setattr(ngram_join, "pairs_of", lambda cells, turn: turns.append(turn) or pairs_of(cells, turn))
    r = random.Random(5)
    frame = [f"f{i}" for i in range(60)]
    rows = [(i, " ".join(frame[: r.choice((52, 60))] + [f"x{r.randrange(12)}_{k}" for k in range(12)])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 120, 9)]
    assert {tuple(x) for x in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)
    assert len(turns) <= most


def test_counts_of_shared_columns_leave_a_block_as_lists(spark, monkeypatch):
    """A table of more blocks has no more rows of counts: each key has one, whatever the blocks that count it."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 20)
    r = np.random.default_rng(8)
    sets = {k: np.unique(r.integers(0, 64, 16, dtype=np.uint64) << np.uint64(58)) for k in range(50)}
    rows = spark.createDataFrame([(k, bytes(h.tobytes())) for k, h in sets.items()], "key bigint, hashes binary").repartition(3)
    counts = ngram_join.shared_counts(rows, 800, 16)
    assert "place#" in counts._jdf.queryExecution().analyzed().toString()
    found = [(x.key, x.shared) for x in counts.collect()]
    assert len(found) == len(sets) and all(n >= len(sets[k]) for k, n in found)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "one two three four five six"
    rows = [(5, text, 0), (5, text, 1), (3, text, 2), (None, text, 3), (7, None, 4), (8, "  \n", 5), (9, "Only FOUR words here", 6), (2, "only four words here", 7), (4, "x y é 你好 z 🙂 w", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node int").withColumns({"columns": docs_column(), "n": docs_column(), "pivot": docs_column()})
    found = sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=str)
    expected = [(2, 1, 2), (3, 2, 3), (4, 2, 4), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 2), (None, 2, None)]
    assert found == sorted(expected, key=str)


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_empty_and_very_long(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).collect() == []
    r = random.Random(4)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = list(words)
    for k in range(0, 60_000, 100):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))]
    assert {tuple(x) for x in ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_force(rows)


def test_keep_one_leaves_the_least_of_each_component(spark):
    rows = [*corpus(7, 80), (None, "alone"), (None, "alone")]
    kept = [r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for *_, c in brute_force(rows)})
    assert kept.count(None) == 2


def test_keep_one_judges_rows_of_one_doc_id_by_their_texts(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(20))
    rows = [(3, words("a")), (5, words("a")), (5, words("b")), (7, words("c")), (7, words("d")), (7, words("d").upper()), (8, None), (8, " "), (8, words("e")), (9, words("e")), (2, words("f")), (2, words("f") + " more")]
    kept = sorted((r.doc_id, (r.text or "").lower().strip()) for r in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    kept = [(i, t if not t.startswith("f0 ") else "f") for i, t in kept]
    assert kept == [(2, "f"), (3, words("a")), (5, words("b")), (7, words("c")), (7, words("d")), (8, ""), (8, words("e"))]


def test_an_empty_text_beside_it_leaves_a_key_as_it_is(spark):
    text = " ".join(f"e{i}" for i in range(20))
    large = 2**60 + 1
    rows = ngram_join.sets_in(spark.createDataFrame([(1, None), (None, text), (large, text)], SCHEMA).coalesce(1)).collect()
    alone = ngram_join.sets_in(spark.createDataFrame([(large, text)], SCHEMA)).first()
    assert [(r.k1, r.k2) for r in rows if r.doc_id == large] == [(alone.k1, alone.k2)]


def test_counts_of_shared_columns_are_never_too_low(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "TASK_ENTRIES", 40)
    r = np.random.default_rng(3)
    sets = {k: np.unique(r.integers(0, 60, 12, dtype=np.uint64) << np.uint64(54)) for k in range(40)}
    rows = spark.createDataFrame([(k, bytes(h.tobytes())) for k, h in [*sets.items(), (3, sets[3])]], "key bigint, hashes binary").repartition(3)
    found = {x.key: x.shared for x in ngram_join.shared_counts(rows, 100, 16).collect()}
    for k, own in sets.items():
        others = np.concatenate([h for j, h in sets.items() if j != k])
        assert found.get(k, 0) >= np.isin(own, others).sum()


def test_prefixes_of_linked_sets_meet():
    r = random.Random(12)
    for _ in range(4000):
        a = set(r.sample(range(120), r.randrange(6, 60)))
        b = {x for x in a if r.random() < r.choice((0.7, 0.9, 0.95))} | set(r.sample(range(120), r.randrange(4)))
        if b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
            assert set(sorted(a)[: ngram_join.prefix_length(len(a))]) & set(sorted(b)[: ngram_join.prefix_length(len(b))])


def test_words_of_texts_are_hashed_together(monkeypatch):
    """Not word by word, but for very long ones; and whatever stands beside a word, before and after it."""
    import numpy as np

    calls, one = [], ngram_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngram_join.xxhash, "xxh3_64_intdigest", lambda word: calls.append(word) or one(word))
    r = random.Random(6)
    words = ["".join(r.choice("abé\0") for _ in range(1 + k % 40)) for k in range(400)] + ["z" * 64, "z" * 65, "a", "a\0", "a\0\0"]
    words = list(dict.fromkeys(w for w in words if w.strip()))
    hashes = {w: int(ngram_join.word_hashes(f"{r.choice(('', ' ', chr(9)))}{w}{r.choice(('', chr(10)))}")[0]) for w in words}
    assert len(set(hashes.values())) == len(words) and set(calls) <= {w.encode() for w in words if len(w.encode()) > ngram_join.LONG_WORD}
    texts = [None, "", " \n ", *(" ".join(r.choices(words, k=r.randrange(12))).upper() for _ in range(300)), "tail "]
    for limit in (1, 500, 1 << 16):
        monkeypatch.setattr(ngram_join, "TOGETHER", limit)
        assert all(np.array_equal(a, ngram_join.shingle_set(t)) for a, t in zip(ngram_join.shingle_sets(texts), texts, strict=True))
    text = " ".join(words)
    assert ngram_join.word_hashes(text).tolist() == [hashes[w] for w in text.split(" ")]


def test_commonness_leaves_a_block_as_lists(spark, monkeypatch):
    """A table of more blocks has no more rows of counts; frequent columns and others are counted."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(ngram_join, "FREQUENT_ROWS", 12)
    r = np.random.default_rng(8)
    sets = {k << 33 | k: np.unique(r.choice(40, 16) * np.uint64(2**64 // 41)) for k in range(50)}
    rows = spark.createDataFrame([(k, len(h), bytes(h.tobytes())) for k, h in sets.items()], "node bigint, n bigint, hashes binary").repartition(3)
    found = ngram_join.with_commonness(rows)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "place#" in plan and "collect_list" not in plan
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    often = {x.id: np.frombuffer(x.often, np.uint32).tolist() for x in found.collect()}
    assert often == {k: counts[np.searchsorted(values, h)].tolist() for k, h in sets.items()}


def test_blocks_are_found_without_sorting_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    plans, write = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and write(df, name))
    rows = spark.range(12).select(F.col("id").alias("node"), F.lit(20).cast("long").alias("n"), F.lit(22).cast("long").alias("reach"), F.array(F.col("id") % 3).alias("columns"))
    pairs = ngram_join.pairs_of(ngram_join.size_cells(rows), 0)
    assert sorted((x.node, x.pivot) for x in pairs.collect()) == [(k, 9 + k % 3) for k in range(9)]
    assert "SortAggregate" not in plans["blocks"]


@pytest.mark.parametrize("most, moves", [(1_000, False), (3, True)])
def test_texts_are_chosen_where_they_are(spark, monkeypatch, most, moves):
    """Many ids, of which some are negative or null, are told to the tasks as bits; only those far apart shuffle texts."""
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", 2)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_BITS", most)
    r = random.Random(3)
    ids = [*range(-70, 130), 2**62, -(2**63), None]
    some = [*r.sample(ids[:-1], 90), 2**61]
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in ids], "doc_id bigint, text string, n string")
    chosen = spark.createDataFrame([(i,) for i in some], "doc_id bigint")
    for how, wanted in (("left_semi", set(some) - {2**61}), ("left_anti", set(ids) - set(some))):
        found = ngram_join.among(docs, chosen, how)
        assert {(x.doc_id, x.text, x.n) for x in found.collect()} == {(i, f"text {i}", "x") for i in wanted}
        assert ("Exchange hashpartitioning(doc_id" in found._jdf.queryExecution().executedPlan().toString()) == moves
    joined = []
    monkeypatch.setattr(ngram_join, "among", lambda *a, among=ngram_join.among: joined.append(a[2]) or among(*a))
    rows = corpus(7, 80)
    kept = [x.doc_id for x in ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept) == sorted({c for *_, c in brute_force(rows)}) and joined == ["left_semi", "left_anti"]
