"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Nothing is known about it:
successive prefixes of a conversation are rendered, and what one more turn appends is that turn's
span. The place of the text inside the span comes from rendering the same turn with a one-character
probe. A template whose longer output doesn't start with the shorter one rewrites history; such a
conversation is marked and gets no loss mask.

The true prefixes are rendered, from the first turn on: a template may depend on any of them. One
conversation is held and its work grows with the square of its turns. Only a template declared
memoryless (what a turn appends depends on that turn alone, as in `instruct`) streams: it is rendered
in parts of at most `window` turns, each with the last turn before it as context, so work grows with
the number of turns and a part is the most that is held. (A digest over a conversation is a chain, so
one conversation stays in one task.)

Edge cases: null text is empty, null role is empty; turns go by (turn, role, text), nulls first,
and repeated rows are turns of their own. The probe is a private character that the texts don't hold,
so texts may hold some of them. A null conv_id is a conversation of its own. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import pick

Turns = list[tuple[str, str]]
#: What the instruction template reserves.
CONTROL = ("[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]", "<s>", "</s>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_PARTS = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) \[/TURN\]", re.DOTALL
)
#: The probe is the first of these characters that a conversation's texts don't hold.
PROBES = tuple(map(chr, range(0xE000, 0xF900)))
PART = "conv_id bigint, part int, formatted string, turns array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>, rewrites boolean"


def escape(text: str) -> str:
    """Reversible, and no control string is left: backslashes double, and one goes into each
    control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def instruct(turns: Turns) -> str:
    """User turns between [INST] marks, assistant turns between <s> marks, others with their role."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f"<s> {body} </s>")
        else:
            out.append(f"[ROLE] {escape(role)} [/ROLE] {body} [/TURN]")
    return "".join(out)


def parse_instruct(formatted: str) -> Turns:
    """The turns again, from the output alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = _PARTS.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "other" else None
        turns.append((kind or unescape(m["role"]), unescape(m[kind or "other"])))
    return turns


def locate(render: Callable[[Turns], str], context: Turns, turns: Turns) -> tuple[str, list[tuple], bool]:
    """What `turns` append after `context`: the text, per turn (role, start, end, text start,
    text end) in it (text -1, -1 where it can't be told), and whether history is rewritten."""
    probe_text = next((c for c in PROBES if not any(c in text or c in role for role, text in (*context, *turns))), None)
    if probe_text is None:
        raise ValueError("a conversation that holds every private character has none for a probe")
    before = render(context)
    origin, seen, spans, rewrites = len(before), list(context), [], False
    for role, text in turns:
        probe = render([*seen, (role, probe_text)])
        seen.append((role, text))
        after = render(seen)
        if not after.startswith(before) or not probe.startswith(before):
            rewrites = True
        added, sample = after[len(before) :], probe[len(before) :]
        at, where = sample.find(probe_text), (-1, -1)
        tail = sample[at + 1 :]
        if at >= 0 and added.startswith(sample[:at]) and added.endswith(tail) and len(added) >= at + len(tail):
            where = (len(before) - origin + at, len(after) - origin - len(tail))
        spans.append((role, len(before) - origin, len(after) - origin, *where))
        before = after
    return before[origin:], spans, rewrites


def format_conversations(turns: DataFrame, render: Callable[[Turns], str] = instruct, window: int = 64, memoryless: bool | None = None) -> DataFrame:
    """Rows of PART: a conversation's parts, in order, in one partition; one part only, unless the
    template is memoryless (None: it is, if it is `instruct`). The loss mask is the text spans of the
    turns with role assistant, and void where any part of the conversation has rewrites."""
    whole = not (render is instruct if memoryless is None else memoryless)
    rows = pick(turns, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, part, context, held, done, began = None, 0, [], [], [], False

        def flush() -> None:
            nonlocal part, context, held
            if held:
                text, spans, rewrites = locate(render, context, held)
                done.append((conv, part, text, spans, rewrites))
                part, context, held = part + 1, held[-1:], []

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=["conv_id", "part", "formatted", "turns", "rewrites"]).astype({"conv_id": "Int64"})
            done.clear()
            return frame

        for batch in batches:
            for c, role, text in zip(batch.conv_id, batch.role, batch.text, strict=True):
                c = None if pd.isna(c) else int(c)
                if not began or c != conv:
                    flush()
                    conv, part, context, began = c, 0, [], True
                held.append((role, text))
                if not whole and len(held) >= window:
                    flush()
            yield taken()
        flush()
        yield taken()

    return rows.mapInPandas(parts, PART)


def read_back(parts: DataFrame, parse: Callable[[str], Turns] = parse_instruct) -> DataFrame:
    """One row a conversation from the output of format_conversations, as it comes or stored and reread in
    any order: digests of what the formatted text says, and of the text under the loss mask (none where any
    part has rewrites)."""
    rows = pick(parts, "conv_id", "part", "formatted", "turns", "rewrites").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, done = None, None, []

        def close() -> None:
            if state:
                if state["rewrites"]:
                    state["loss_n"], state["loss"] = 0, hashlib.sha256()
                done.append((conv, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"], state["rewrites"]))

        for batch in batches:
            for c, part, text, spans, rewrites in zip(batch.conv_id, batch.part, batch.formatted, batch.turns, batch.rewrites, strict=True):
                if part == 0:
                    close()
                    conv = None if pd.isna(c) else int(c)
                    state = {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "rewrites": False}
                for role, body in parse(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    if span["role"] == "assistant" and span["text_start"] >= 0 and not rewrites:
                        body = unescape(text[span["text_start"] : span["text_end"]])
                        state["loss_n"] += len(body)
                        state["loss"].update(body.encode())
                state["chars"] += len(text)
                state["rewrites"] |= bool(rewrites)
            frame = pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])
            done.clear()
            yield frame.astype({"conv_id": "Int64"})
        close()
        frame = pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])
        yield frame.astype({"conv_id": "Int64"})

    return rows.mapInPandas(
        digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean",
    )
