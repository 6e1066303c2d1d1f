"""Spaced-seed decontamination against plain Python."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import decontaminate
from palimpsest.llm.decontaminate import MASKS, MISMATCH

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
BREAK = re.compile(r"[\s!-/:-@\[-`{-~ -¿ -⁯　-〿！-／]+")


def cut(text):
    return [w for w in BREAK.split((text or "").lower()) if w]


def best_run(doc, item, shift):
    """The best-scoring stretch by all (start, stop); the earliest of the shortest-reaching ones."""
    score = n = start = 0
    best = (0, 0, 0, 0)
    for k, word in enumerate(item):
        if score <= 0:
            score, n, start = 0, 0, k
        same = 0 <= shift + k < len(doc) and doc[shift + k] == word
        score, n = score + (1 if same else -MISMATCH), n + same
        if score > best[0]:
            best = (score, n, start, k + 1)
    return best[1:]


def brute_force(docs, items, min_match=decontaminate.MIN_MATCH):
    found = {}
    for doc_id, text in docs:
        doc = cut(text)
        for item_id, item_text in items:
            item = cut(item_text)
            enough = min(min_match, -(-len(item) * 4 // 5))
            shifts = set()
            for mask in MASKS if len(item) >= min(map(len, MASKS)) else ["1" * len(item)] if item else []:
                ones = [k for k, c in enumerate(mask) if c == "1"]
                places = defaultdict(list)
                for at in range(len(item) - len(mask) + 1):
                    places[tuple(item[at + k] for k in ones)].append(at)
                for at in range(len(doc) - len(mask) + 1):
                    shifts |= {at - x for x in places.get(tuple(doc[at + k] for k in ones), ())}
            runs = [(n, shift + a, shift + b) for shift in shifts for n, a, b in [best_run(doc, item, shift)] if n >= enough]
            if runs:
                top = max(n for n, *_ in runs)
                start = min(a for n, a, _ in runs if n == top)
                found[doc_id, item_id] = (top, start, max(b for n, a, b in runs if n == top and a == start))
    return found


def test_equal_to_plain_python(spark):
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(fresh(r.choice((4, 6, 7, 8, 12, 30))))) for i in range(30)]
    docs = []
    for i in range(120):
        words = fresh(r.randrange(0, 60))
        if r.random() < 0.6:
            part = r.choice(items)[1].split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(words) + 1)
            words = words[:at] + part[r.choice((0, 0, 2)) :] + words[at:]
        docs.append((i, r.choice((" ", ", ", "\n")).join(words).upper()))
    got = decontaminate.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x.doc_id, x.item_id): (x.n_match, x.doc_start, x.doc_stop) for x in got} == brute_force(docs, items)
    assert len(got) == len({(x.doc_id, x.item_id) for x in got})


def test_query_on_documents(spark):
    from palimpsest.llm.registry import op3_decontaminate

    read = lambda name, key: [tuple(x) for x in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(key, "text").collect()]
    got = {(x.doc_id, x.item_id): (x.n_match, x.doc_start, x.doc_stop) for x in op3_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_force(read("documents", "doc_id"), read("benchmark", "item_id"))


PASSAGE = "which river crosses the old town before it meets the northern sea near the harbour wall"


def test_substitutions_are_tolerated_and_clean_texts_stay(spark):
    words = PASSAGE.split()
    swapped = " ".join("other" if i in (4, 10) else w for i, w in enumerate(words))
    docs = [(1, "before " + PASSAGE + " after"), (2, swapped), (3, "which river crosses the field"), (4, None), (5, ""), (None, PASSAGE), (None, "clean")]
    table, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "short one")], ITEMS)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(table, items).collect()} == {(1, 1), (2, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(table.withColumn("words", F.lit("clash")), items).collect()) == [3, 4, 5]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, PASSAGE)], ITEMS)
    docs = spark.createDataFrame([(1, PASSAGE)], DOCS)
    assert decontaminate.find(none, items).collect() == []
    assert decontaminate.find(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert decontaminate.clean(docs, spark.createDataFrame([], ITEMS)).count() == 1


def test_beyond_the_broadcast_bound_results_are_the_same(spark, monkeypatch):
    docs, items = spark.createDataFrame([(1, PASSAGE), (2, "clean words only")], DOCS), spark.createDataFrame([(1, PASSAGE)], ITEMS)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_SEEDS", 0)
    for bound in ("MAX_BROADCAST_IDS", "MAX_BROADCAST_HITS", "MAX_BROADCAST_CHARS"):
        monkeypatch.setattr(decontaminate, bound, 0)
    assert [r.doc_id for r in decontaminate.find(docs, items).collect()] == [1]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_short_items_are_found_as_a_whole(spark):
    docs = [(1, "say open the gate now"), (2, "open, the GATE"), (3, "open a gate"), (4, "gate"), (5, "the gate open the"), (6, "nothing")]
    items = [(1, "Open the gate!"), (2, "gate"), (None, "nothing")]
    got = decontaminate.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x.doc_id, x.item_id): (x.n_match, x.doc_start, x.doc_stop) for x in got} == brute_force(docs, items)
    assert (1, 1) in {(x.doc_id, x.item_id) for x in got} and (3, 1) not in {(x.doc_id, x.item_id) for x in got}


def test_long_text_and_long_item(spark):
    """An item of 20,000 words, in a text as long, in a part of it, and beside many short ones with one beginning."""
    r = random.Random(2)
    long = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    items = [(1, " ".join(long)), *((k, f"one beginning that all of these items share and then {k} {k + 1} {k + 2}") for k in range(2, 40))]
    docs = [(1, " ".join(long)), (2, " ".join(long[5_000:5_200])), (3, "x y z " + " ".join(long[19_950:])), (4, "clean " * 20_000), (5, items[7][1])]
    got = {(x.doc_id, x.item_id): x.n_match for x in decontaminate.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {k: n for k, n in got.items() if k[1] == 1} == {(1, 1): 20_000, (2, 1): 200, (3, 1): 50}
    assert got[5, items[7][0]] == len(items[7][1].split()) and 4 not in {d for d, _ in got}
