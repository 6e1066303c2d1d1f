"""Secret scans: base spans by plain patterns, Viterbi against all taggings, held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from palimpsest.llm import secret_scan as s

SCHEMA = "doc_id bigint, text string"


def base(text):
    """The contract's patterns, as said: all matches, then those long enough."""
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end())] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", text):
        out += [(m.start(), 2, m.end())] * (len(m[0]) >= 32)
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


TEXTS = [
    None, "", "plain", "password = hunter22", "Token:abc", "apiKEY=\"abcdefgh\" api_key : '12345678'", "secret=" + "a1" * 20, "AKIA" + "A" * 11, "AKIA" + "A1" * 8,
    "x" + "0f" * 16, "0f" * 15 + "0", "g" + "a" * 33 + "G", "TOKEN=AKIA" + "B" * 16, "paſsword=hunter22", "toKen=hunter22", "🙂 password=🙂abcdefgh passwd=abcdefgh", "secretsecret==abcdefgh",
]


def test_base_spans():
    for text in TEXTS:
        assert s.base_spans(text or "") == base(text), text


@pytest.fixture(scope="module")
def field(spark):
    return s.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_query_keeps_base_spans(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS)], SCHEMA))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in s.digest(docs, field).collect():
        wanted = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in wanted)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in wanted) for k in s.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert ",".join(":".join(x) for x in spans if x[0] != "crf") == joined
        assert all(0 <= int(a) < int(b) <= len(texts[r.doc_id]) for _, a, b in spans)


def test_viterbi_is_the_best_of_all_taggings():
    r = np.random.default_rng(1)
    for _ in range(40):
        moves = r.normal(size=(3, 3))
        moves[s.O, s.I] = s.IMPOSSIBLE
        n = int(r.integers(1, 6))
        field = s.Field({f"f{i}": r.normal(size=3) for i in range(n)}, moves)
        features = [[f"f{i}"] if r.random() < 0.8 else [] for i in range(n)]
        emit = field.emissions(features)
        total = lambda tags: sum(emit[i][t] for i, t in enumerate(tags)) + sum(moves[a][b] for a, b in itertools.pairwise(tags)) + (s.IMPOSSIBLE if tags[0] == s.I else 0)  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=total)
        assert total(tuple(field.decode(features))) == pytest.approx(total(best))


def test_accuracy_on_lines_not_trained_on(field):
    right = found = true = 0
    for line, secrets in s.made_up_lines(400, seed=99):
        got = {(a, b) for _, a, b in s.base_spans(line) + s.field_spans(line, field, s.base_spans(line))}
        hit = {x for x in secrets if any(a < x[1] and x[0] < b for a, b in got)}
        right, found, true = right + len(hit), found + len(got), true + len(secrets)
    assert right / true >= 0.9 and right / found >= 0.9


def test_stretches_cover_every_candidate_once():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab1 \n.=" + " " * 6) for _ in range(r.randrange(900)))
        tokens = [t for stretch in s.stretches(text) for t in stretch]
        assert all(a < b and text[a:b] == t for a, b, t in tokens)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(tokens))
        assert [t for t in tokens if s.may_be_secret(t[2])] == [(m.start(), m.end(), m[0]) for m in s.TOKEN.finditer(text) if s.may_be_secret(m[0])]


def test_redact_and_edge_cases(spark, field):
    docs = spark.createDataFrame([(1, "set password=hunter22 now", "k"), (1, None, "k"), (2, "", None), (None, "clean words", "k")], SCHEMA + ", spans string")
    rows = s.redact(docs, field).collect()
    assert sorted(((r.doc_id, r.text, r.spans) for r in rows), key=str) == sorted([(1, "set [SECRET] now", "k"), (1, None, "k"), (2, "", None), (None, "clean words", "k")], key=str)
    none = spark.createDataFrame([], SCHEMA)
    assert s.digest(none, s.learn(none)).collect() == []
    long = "filler words " * 100_000 + "token=abcdefgh99"
    assert s.digest(spark.createDataFrame([(1, long)], SCHEMA), field).first().n_assign == 1
