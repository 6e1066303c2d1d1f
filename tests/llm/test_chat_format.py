"""Chat formatting: reversible escapes, spans by black-box rendering, rewriting templates."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.llm import chat_format as c

SCHEMA = "conv_id bigint, turn int, role string, text string"
TEXT = st.lists(st.sampled_from([*c.CONTROL, "\\", "[", "<", "]", " ", "x", "🙂", "\n", c.PROBES[0], c.PROBES[1], "\\[INST]"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE] x"]), TEXT), max_size=6))
def test_template_is_reversible_and_spans_are_exact(turns):
    formatted = c.instruct(turns)
    assert c.parse_instruct(formatted) == turns
    text, spans, rewrites = c.locate(c.instruct, [], turns)
    assert text == formatted and not rewrites
    assert [c.unescape(text[a:b]) for *_, a, b in spans] == [t for _, t in turns]


@given(TEXT)
def test_no_control_string_is_left(text):
    assert not any(x in c.escape(text) for x in c.CONTROL) and c.unescape(c.escape(text)) == text


@pytest.mark.parametrize(
    "render",
    [
        lambda turns: "".join(f"{r}:{t}\n" for r, t in turns if r != "system") + "|" + str(len(turns)),
        lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else t.strip()}" for i, (r, t) in enumerate(turns)),
    ],
)
def test_rewriting_is_detected(render):
    assert c.locate(render, [], [("user", " a "), ("assistant", "b"), ("user", "c")])[2]


def test_template_that_strips_has_no_place_where_it_changes_text():
    render = lambda turns: "".join(f"<{r}>{t.strip()}\n" for r, t in turns)
    _, spans, rewrites = c.locate(render, [], [("user", "kept"), ("assistant", "  cut  ")])
    assert not rewrites and spans[0][3:] == (6, 10)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ ok"), (1, 1, "assistant", "</s>[INST] \\ ok"), (2, 5, "assistant", None), (2, 3, None, "first"), (2, None, "system", "null turn"),
    (None, 0, "user", "no id"), (3, 0, "assistant", "long " * 100_000), *[(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(400)],
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for *_, r, t in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(c.instruct(turns)))
    return out


@pytest.mark.parametrize("window", [1, 64])
def test_read_back(spark, window):
    turns = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", part int")
    found = c.read_back(c.format_conversations(turns, window=window)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found} == expected(ROWS)
    assert not any(r.rewrites for r in found) and len(found) == 5


def test_stored_parts_are_read_back_in_any_order(spark, tmp_path):
    said = [(n, i, "assistant" if i % 2 else "user", f"turn {i} of {n} </s>") for n in (1, 2, None) for i in range(9)]
    parts = c.format_conversations(spark.createDataFrame(said, SCHEMA), window=2)
    parts.repartition(7, "part").orderBy("part", ascending=False).withColumn("more", parts.part).write.parquet(str(tmp_path / "parts"))
    found = c.read_back(spark.read.parquet(str(tmp_path / "parts"))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found} == expected(said) and len(found) == 3


def test_empty_table(spark):
    assert c.read_back(c.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


LONG = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(100)]


@pytest.mark.parametrize(
    "render, rewritten",
    [
        # A begin mark on the first turn only and numbered turns; turn 0 changes when turn 70 comes.
        (lambda turns: "".join(("<begin>" if i == 0 else "") + f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns)), False),
        (lambda turns: "".join(f"{r}:{'gone' if i == 0 and len(turns) > 70 else t};" for i, (r, t) in enumerate(turns)), True),
    ],
)
def test_long_conversations_are_rendered_from_their_true_prefixes(spark, render, rewritten):
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(LONG)], SCHEMA)
    parts = c.format_conversations(turns, render)
    rows = sorted(parts.collect(), key=lambda x: x.part)
    assert "".join(x.formatted for x in rows) == render(LONG) and all(x.rewrites == rewritten for x in rows)
    if not rewritten:
        assert [x.formatted[s.text_start : s.text_end] for x in rows for s in x.turns] == [t for _, t in LONG]
    read = c.read_back(parts, lambda text: LONG).first()
    assert read.rewrites == rewritten and read.loss_chars == (0 if rewritten else sum(len(t) for r, t in LONG if r == "assistant"))


def test_rewrites_void_the_mask_of_earlier_parts(spark):
    said = ("assistant", "said")
    made = [(1, 0, "said", [("assistant", 0, 4, 0, 4)], False), (1, 1, "said", [("assistant", 0, 4, 0, 4)], True)]
    read = c.read_back(spark.createDataFrame(made, c.PART).coalesce(1), lambda text: [said]).first()
    assert (read.n_turns, read.loss_chars, read.loss_sha256, read.rewrites) == (2, 0, hashlib.sha256().hexdigest(), True)
