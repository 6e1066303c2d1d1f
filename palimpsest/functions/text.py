"""Text rules and hashes as Column expressions; hashes run on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_padded(c: Column) -> Column:
    """True with Unicode white space at either end (Spark's trim knows the space alone)."""
    return c.rlike(r"(?U)^\s|\s$")


def is_bad_text(c: Column) -> Column:
    """True for a null, empty or padded value."""
    return c.isNull() | (c == "") | is_padded(c)


def is_bad_optional(c: Column) -> Column:
    return c.isNotNull() & ((c == "") | is_padded(c))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_each(c: Column) -> Column:
    """Lower case letter by letter: a capital sigma gives the medial form everywhere."""
    return F.lower(F.translate(c, "Σ", "σ"))


def normalized(c: Column) -> Column:
    """Runs of other than letters and numbers become one space; lower case; no outer spaces."""
    return F.trim(lower_each(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]+", " ")))


def slug(c: Column) -> Column:
    """At most 32 characters of the normal form, hyphens for spaces; `entity` where nothing is left."""
    return F.coalesce(F.nullif(F.replace(F.substring(normalized(c), 1, 32), F.lit(" "), F.lit("-")), F.lit("")), F.lit("entity"))


def exact_key(c: Column) -> Column:
    return lower_each(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def token_set(c: Column) -> Column:
    """Distinct lower-case runs of letters and numbers of more than one byte."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) > 1))


#: Bytes of a block of values that are hashed together, padding included.
BLOCK_BYTES = 1 << 24


def _blocks(values: list[bytes]):
    """Blocks of values of like length: (which, their bytes by position). Padding is bounded, as values
    come by length, so that a long one stands alone."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] * (end + 1 - at) <= BLOCK_BYTES and sizes[order[end]] <= 2 * sizes[order[at]] + 64:
            end += 1
        which = order[at:end]
        width = int(sizes[which[-1]])
        flat = np.frombuffer(b"".join(values[i].ljust(width, b"\0") for i in which), np.uint8)
        yield which, np.ascontiguousarray(flat.reshape(len(which), width).T), sizes[which]
        at = end


def fnv1a(values: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each value, one vector step for each byte position of a block."""
    out = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    for which, columns, sizes in _blocks(values):
        state = out[which]
        for i, column in enumerate(columns):
            live = np.searchsorted(sizes, i, "right")
            state[live:] = (state[live:] ^ column[live:]) * np.uint64(0x100000001B3)
        out[which] = state
    return out


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0x82F63B78), _CRC >> 1).astype(np.uint32)


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32 with the Castagnoli polynomial (Spark's crc32 uses another)."""
    out = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for which, columns, sizes in _blocks(values):
        state = out[which]
        for i, column in enumerate(columns):
            live = np.searchsorted(sizes, i, "right")
            state[live:] = _CRC[(state[live:] ^ column[live:]) & 0xFF] ^ (state[live:] >> np.uint32(8))
        out[which] = state
    return out ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(T.StringType())
def _hash_hex(parts: pd.Series) -> pd.Series:
    joined = [b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in row) for row in parts]
    return pd.Series([f"{h:016x}" for h in fnv1a(joined)], dtype=object)


def stable_hash(*parts: Column) -> Column:
    """16 hex digits: FNV-1a over the parts, each behind its byte length (8 bytes, little-endian)."""
    return _hash_hex(F.array(*[F.coalesce(p, F.lit("")) for p in parts]))


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c_of([bytes(x) for x in data]).astype(np.int64))


def tokens_of(c: Column, bytes_per_token: int = 4) -> Column:
    """Estimated tokens of a text: its bytes over bytes_per_token, rounded up, one at least."""
    if bytes_per_token <= 0:
        raise ValueError("bytes_per_token must be positive")
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / bytes_per_token)).cast("long")


def optional_tokens(c: Column, bytes_per_token: int = 4) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(tokens_of(c, bytes_per_token)).cast("long")


def node_tokens(n: int = 4) -> Column:
    """Of a node row: all its texts and attributes, and 6."""
    attributes = F.aggregate(
        F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))),
        F.lit(0).cast("long"),
        lambda a, e: a + tokens_of(e["key"], n) + tokens_of(e["value"], n),
    )
    texts = [tokens_of(F.col(c), n) for c in ("id", "kind", "label")] + [optional_tokens(F.col(c), n) for c in ("repository", "branch")]
    return sum(texts[1:], texts[0]) + attributes + 6


def fact_tokens(n: int = 4) -> Column:
    """Of a fact row: its ids, relation and evidence, and 16."""
    evidence = F.aggregate(
        "evidence",
        F.lit(0).cast("long"),
        lambda a, e: a + tokens_of(e["kind"], n) + tokens_of(e["source"], n) + optional_tokens(e["locator"], n) + optional_tokens(e["digest"], n),
    )
    texts = [tokens_of(F.col(c), n) for c in ("id", "source", "relation", "target")]
    return sum(texts[1:], texts[0]) + evidence + 16
