"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Three patterns find assigned values, access keys and long hex strings. The field adds spans that
no pattern covers: it tags tokens as begin, inside or outside of a secret from their shape, the
words around them and the text as a whole, and is decoded by Viterbi. Only a token with a digit or
of `LONG` characters may be part of a secret, all others are held outside; two neighbouring tokens
that are held outside cut the chain, so each stretch around such candidates is decoded for itself.
Words count as neighbours within `CONTEXT` characters. So secrets of fewer than `LONG` letters without
a digit are out of the field's reach.

The field is trained here, by maximum likelihood, on the stretches of a bounded sample of texts
(`max_sample`, those of the least hash), tagged by the patterns, and on made-up lines of known
tags for forms of secrets and of harmless numbers that the patterns don't know.

Edge cases: a null or empty text has no spans. Repeated rows get equal results. Texts of any
length are scanned whole. An empty table gives an empty result, and the field is then trained on
the made-up lines alone. Columns of the added names are replaced; others pass through.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import giving_back

#: The base patterns; group 2 of the first is the value.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
LONG = 20
MAX_SAMPLE, MAX_STRETCH = 1_500, 200
CONTEXT = 64
TRIGGER = re.compile(r"[0-9]+|[A-Za-z+/_.=-]{20,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+=*|=+|[^\sA-Za-z0-9+/_.=-]")
#: Words before secrets and before harmless numbers, and well-known beginnings.
KEYWORDS = frozenset(
    "password passwd pass pwd passphrase secret token apikey api_key key auth authorization bearer credential credentials access private login"
    " order invoice number id version page phone call tel fax ip host server email mail card account commit isbn year date total".split()
)
PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-")
O, B, I = range(3)
IMPOSSIBLE = -1e9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def may_be_secret(token: str) -> bool:
    return len(token) >= LONG or any(c.isdigit() and c.isascii() for c in token)


def stretches(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Tokens around each run of candidates; stretches don't overlap and end between words."""
    n, low, high = len(text), 0, -1
    tokens = lambda: [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, low, high)]
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(n, m.end() + CONTEXT)
        if end <= high:
            continue
        if start > high:
            while start > max(0, high) and not text[start - 1].isspace():
                start -= 1
        while end < n and not text[end].isspace():
            end += 1
        if start > high >= 0:
            yield tokens()
        low, high = (low if start <= high else start), end
    if high >= 0:
        yield tokens()


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def shape(token: str) -> list[str]:
    n, digits = len(token), sum(c.isdigit() for c in token)
    kinds = "".join(k for k, has in (("d", digits), ("l", re.search("[a-z]", token)), ("u", re.search("[A-Z]", token))) if has)
    out = [f"len={min(n // 4, 12)}", f"kinds={kinds}", f"kinds={kinds},len={min(n // 8, 5)}", f"digits={round(4 * digits / n)}", f"entropy={min(10, round(2 * entropy(token)))}"]
    out += [f"has{c}" for c in "./-_+=" if c in token]
    out += [f"starts={p}" for p in PREFIXES if token.startswith(p)]
    if digits == n:
        out.append("number")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        out.append(f"hex,len={min(n // 8, 5)}")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){1,3}\.?", token):
        out.append("dotted")
    return out


def sequence_features(tokens: list[str], file_features: list[str]) -> list[list[str]]:
    """Features of candidates only: the tags of other tokens are held."""
    words = [t.lower().strip("=.-_/+") for t in tokens]
    mark = lambda i: "none" if not 0 <= i < len(tokens) else words[i] if words[i] in KEYWORDS else tokens[i] if len(tokens[i]) == 1 and not tokens[i].isalnum() else "text"
    out = []
    for i, token in enumerate(tokens):
        if not may_be_secret(token):
            out.append([])
            continue
        near = [f"{k:+d}={mark(i + k)}" for k in (-3, -2, -1, 1)]
        key = next((words[j] for j in range(i - 1, max(-1, i - 6), -1) if words[j] in KEYWORDS), None)
        out.append(["bias", *shape(token), *near, f"after={key}", *file_features])
    return out


def file_features(text: str) -> list[str]:
    """The text as a whole: does it assign values, does it look like code, is it long."""
    return [f"file,assigns={min(3, text.count(' = '))}", f"file,braces={min(2, text.count('{') + text.count(';'))}", f"file,long={len(text) > 2000}"]


class Field:
    """Weights by feature and tag, and between tags."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        scores = np.zeros((len(features), 3))
        for row, names in zip(scores, features, strict=True):
            if not names:
                row[B] = row[I] = IMPOSSIBLE
            for name in names:
                if name in self.weights:
                    row += self.weights[name]
        return scores

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the best tags; inside follows begin or inside only."""
        scores, moves = self.emissions(features).tolist(), self.moves.tolist()
        best, back = [scores[0][O], scores[0][B], IMPOSSIBLE], []
        for row in scores[1:]:
            step = [max((best[p] + moves[p][t], -p) for p in range(3)) for t in range(3)]
            back.append([-p for _, p in step])
            best = [step[t][0] + row[t] for t in range(3)]
        tags = [max(range(3), key=lambda t: (best[t], -t))]
        for row in reversed(back):
            tags.append(row[tags[-1]])
        return tags[::-1]


def start_moves() -> np.ndarray:
    moves = np.zeros((3, 3))
    moves[O, I] = IMPOSSIBLE
    return moves


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum likelihood by AdaGrad, one sequence at a time; expectations by forward-backward."""
    weights: dict[str, np.ndarray] = {}
    squares: dict[str, np.ndarray] = {}
    moves, move_squares = start_moves(), np.full((3, 3), 1e-3)
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(sequences)
        for features, tags in sequences:
            field = Field(weights, moves)
            emit, n = field.emissions(features), len(tags)
            first = np.array([0.0, 0.0, IMPOSSIBLE])
            alpha, beta = np.empty((n, 3)), np.zeros((n, 3))
            alpha[0] = emit[0] + first
            for i in range(1, n):
                alpha[i] = logsumexp(alpha[i - 1][:, None] + moves, 0) + emit[i]
            for i in range(n - 2, -1, -1):
                beta[i] = logsumexp(moves + (emit[i + 1] + beta[i + 1])[None, :], 1)
            total = logsumexp(alpha[-1], 0)
            error = np.exp(np.clip(alpha + beta - total, -700, 0))
            for i, tag in enumerate(tags):
                error[i, tag] -= 1
            pull = np.zeros((3, 3))
            for i in range(1, n):
                pull += np.exp(np.clip(alpha[i - 1][:, None] + moves + (emit[i] + beta[i])[None, :] - total, -700, 0))
                pull[tags[i - 1], tags[i]] -= 1
            pull[O, I] = 0
            move_squares += pull**2
            moves = moves - rate * pull / np.sqrt(move_squares)
            for names, wrong in zip(features, error, strict=True):
                if names and abs(wrong).max() > 1e-6:
                    for name in names:
                        w = weights.setdefault(name, np.zeros(3))
                        g = wrong + decay * w
                        q = squares.setdefault(name, np.full(3, 1e-3))
                        q += g**2
                        w -= rate * g / np.sqrt(q)
    return Field({k: np.round(v, 5) for k, v in weights.items()}, moves)


def made_up_lines(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the places of their secrets, from simple frames; half hold none."""
    r = random.Random(seed)
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    letters, alnum = string.ascii_letters, string.ascii_letters + string.digits
    hexes, word = "0123456789abcdef", lambda: some(string.ascii_lowercase, r.randint(2, 9))
    good = [
        lambda: some(alnum, r.randint(16, 44)), lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, 40), lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40),
        lambda: "AIza" + some(alnum + "-_", 35), lambda: some(hexes, r.choice((24, 28, 40, 64))), lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), lambda: some(hexes.upper(), 40),
    ]
    frames = ["password is {}", "Authorization: Bearer {}", "export SECRET_KEY={}", "{} {} key {} {}", "the passphrase , {} , was", "login : admin pass : {}", "credential {}", 'auth "{}"', "access key {}"]
    bad = [
        lambda: some(string.digits, 16), lambda: f"{word()}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.", lambda: f"{r.randint(1900, 2030)}", lambda: f"https://{word()}.example.org/{word()}/{r.randint(1, 999)}?page={r.randint(1, 99)}", lambda: word() * 4, lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: some(letters.lower(), r.randint(20, 26)),
    ]
    out = []
    for k in range(n):
        frame = r.choice(frames) if k % 2 else " ".join(word() for _ in range(r.randint(1, 6))) + " {} " + " ".join(word() for _ in range(r.randint(0, 5)))
        secret = r.choice(good)() if k % 2 else r.choice(bad)()
        fill = [word() for _ in range(frame.count("{}") - 1)]
        at = 2 if len(fill) == 3 else 0
        parts = fill[:at] + [secret] + fill[at:]
        line, place = "", None
        for piece, put in zip(frame.split("{}"), [*parts, ""], strict=True):
            line += piece
            if put is secret:
                place = (len(line), len(line) + len(secret))
            line += put
        lead = " ".join(word() for _ in range(r.randint(0, 4))) + " "
        out.append((lead + line, [(place[0] + len(lead), place[1] + len(lead))] if k % 2 else []))
    return out


def tagged(text: str, secrets: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    out, about = [], file_features(text)
    for stretch in stretches(text):
        tags, before = [], None
        for start, end, token in stretch:
            own = next((s for s in secrets if s[0] < end and start < s[1]), None) if may_be_secret(token) else None
            tags.append(O if own is None else I if own == before else B)
            before = own
        out.append((sequence_features([t for *_, t in stretch], about), tags))
    return out


def learn(docs: DataFrame, text: str = "text", max_sample: int = MAX_SAMPLE) -> Field:
    """The field, trained in the driver on at most 2 * max_sample stretches of at most MAX_STRETCH tokens (from
    max_sample texts, both those of the least hash) and on made-up lines. This bounds the fit alone."""

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(features, tags) for body in batch.body for features, tags in tagged(body, [(a, b) for _, a, b in base_spans(body)])]
            yield pd.DataFrame(rows, columns=["features", "tags"])

    bodies = docs.select(F.col(f"`{text}`").alias("body")).filter(F.col("body").rlike("[0-9]")).withColumn("hash", F.xxhash64("body"))
    # Only hashes travel to one place; the texts below the greatest of them follow from where they are.
    bound = bodies.select("hash").distinct().orderBy("hash").limit(max_sample).agg(F.max("hash")).first()[0]
    some = bodies.filter(F.col("hash") <= F.lit(bound)).dropDuplicates(["hash"]).select("body")
    schema = "features array<array<string>>, tags array<int>"
    rows = some.mapInPandas(giving_back(sequences), schema).filter(F.size("tags") <= MAX_STRETCH).orderBy(F.xxhash64("features")).limit(2 * max_sample).collect()
    found = [([list(f) for f in r["features"]], list(r["tags"])) for r in rows]
    for line, secrets in made_up_lines():
        found += tagged(line, secrets)
    return train(found)


def field_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The field's spans that touch no base span."""
    out, about = [], None
    for stretch in stretches(text):
        about = about or file_features(text)
        tags = field.decode(sequence_features([t for *_, t in stretch], about))
        for (start, end, _), tag in zip(stretch, tags, strict=True):
            if tag == B or (tag == I and not out):
                out.append(["crf", start, end])
            elif tag == I:
                out[-1][2] = end
    return [tuple(s) for s in out if not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def scan(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with spans: array of (kind, start, end) in code points, by start, then kind."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for body in texts:
            base = base_spans(body) if body else []
            found = base + (field_spans(body, field, base) if body else [])
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))])
        return pd.Series(out)

    return docs.withColumn("spans", spans(F.col(f"`{text}`")))


def joined(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(docs: DataFrame, field: Field) -> DataFrame:
    rows = scan(docs, field)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span (overlapping ones as one) replaced by mark."""
    columns = docs.columns

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for body in texts:
            if not body:
                out.append(body)
                continue
            base = base_spans(body)
            found, at, parts = sorted((a, b) for _, a, b in base + field_spans(body, field, base)), 0, []
            for a, b in found:
                if a >= at:
                    parts += [body[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, body[at:]]))
        return pd.Series(out)

    return docs.withColumn(text, masked(F.col(f"`{text}`"))).select(*columns)
