"""Line-first rules: the whole-text counts against plain Python, and the rules by example."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_rules
from palimpsest.llm.registry import op9_line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute_force(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(windows) < 3000 else None
    if covered is None:
        first, covered = {}, set()
        for i, w in enumerate(windows):
            first.setdefault(w, []).append(i)
        covered = {i + k for at in first.values() if len(at) > 1 for i in at for k in range(8)}
    repeat = len(covered)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def texts(seed=1):
    r = random.Random(seed)
    out = [None, "", " \n\t ", "\n\n", "a", "a b c d e f g h", "a a a a a a a a a", "a b c d e f g h " * 3, "🙂 é x # $ | <b>\n🙂 é x # $ | <b>", "x\r\ny\r\nx\r\n", "\x0b\x0c\x1f y"]
    for _ in range(120):
        lines = [" ".join(r.choice("alpha beta gamma. delta! | # $ menu >".split()) for _ in range(r.randrange(14))) for _ in range(r.randrange(1, 9))]
        out.append("\n".join(r.choice(lines) for _ in range(r.randrange(1, 14))))
    out.append(" ".join(f"w{r.randrange(300)}" for _ in range(20_000)))
    return out


def test_counts_equal_plain_python(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cleaned", F.lit("clash"))
    found = {r.doc_id: tuple(r[c] for c in COUNTS) for r in line_rules.apply_rules(docs).collect()}
    assert found == {i: brute_force(t) for i, t in rows}


def test_query_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = op9_line_rules(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in found} == {r.doc_id: brute_force(r.text) for r in rows}
    assert not any(r.kept and r.base_failed for r in found)


PROSE = "The committee met in the old hall and agreed on a plan for the bridge. It will open to carts in the spring.\n"


@pytest.mark.parametrize(
    "line, stays",
    [
        ("A plain sentence ends with a mark.", True),
        ("Home | About | Contact | Login", False),
        ("All rights reserved. Click here.", False),
        ("no mark at the end of this short line", False),
        ("wow ! ! ! ! great ! yes !", False),
        ("again again again again again again again again again again again.", False),
        ("", True),
    ],
)
def test_rules_on_lines(spark, line, stays):
    row = line_rules.apply_rules(spark.createDataFrame([(1, PROSE + line)], "doc_id bigint, text string")).first()
    assert row.cleaned == (PROSE + line if stays else PROSE.rstrip("\n")) and row.kept


def test_document_that_loses_too_much_goes(spark):
    menu = "Home | About | Contact | Login | Search | Imprint | Help | Jobs\n" * 1 + "\n".join(f"Item {i} | Price {i} | Buy | Share" for i in range(9))
    assert not line_rules.apply_rules(spark.createDataFrame([(1, PROSE + menu)], "doc_id bigint, text string")).first().kept


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_rules.apply_rules(docs).collect() == []
    assert "Python" not in line_rules.apply_rules(docs)._jdf.queryExecution().toString()
