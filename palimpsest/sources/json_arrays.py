"""Files that hold one large JSON array, read in blocks of bytes.

Spark's reader gives such a file (multiLine) to one task. Here a file is divided at byte offsets, and
elements belong to the block in which they begin. Whether a block begins within a string, and how deep,
depends on all before it: a first pass says for each block where each possible start would lead, a scan
over these summaries (one short row a block) settles the starts, and a second pass cuts the elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue
from palimpsest.sources.storage import opened, ship

BLOCK_BYTES = 8 << 20
TASK_BYTES = 4 << 20  # smaller blocks share a task
MAX_TASKS = 10_000  # a task takes several blocks beyond this
BATCH_BYTES = 8 << 20

OUTSIDE, STRING, ESCAPE = 0, 1, 2  # where a block may begin: outside strings, in one, in one after a backslash
_REST = re.compile(rb'(?:[^"\\]+|\\.)*+(")?', re.DOTALL)
_TOKEN = re.compile(rb'"(?:[^"\\]+|\\.)*+(")?|([\[\]{},])', re.DOTALL)
_DEPTH = {b"[": 1, b"{": 1, b"]": -1, b"}": -1, b",": 0}

Read = Callable[[int, int], bytes]


def marks(data: bytes, state: int) -> Iterator[tuple[int, bytes | int]]:
    """(offset, mark) of brackets, braces and commas outside strings; last (length, state at the end)."""
    at = 0
    if state != OUTSIDE:
        rest = _REST.match(data, 1 if state == ESCAPE else 0)
        if not rest.lastindex:
            yield len(data), STRING if rest.end() == len(data) else ESCAPE
            return
        at = rest.end()
    end = OUTSIDE
    for token in _TOKEN.finditer(data, at):
        if token.lastindex == 2:
            yield token.start(), token[2]
        elif token.lastindex is None:
            end = STRING if token.end() == len(data) else ESCAPE
    yield len(data), end


def summary(data: bytes) -> list[tuple[int, int]]:
    """(state at the end, change of depth) for each state at the start."""
    out = []
    for state in (OUTSIDE, STRING, ESCAPE):
        depth = 0
        for _, mark in marks(data, state):
            if isinstance(mark, int):
                out.append((mark, depth))
            else:
                depth += _DEPTH[mark]
    return out


def elements(read: Read, offset: int, size: int, step: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the elements that begin within the block; the last one is read to its end."""
    begin, held, base = None, [], offset
    data = read(offset, size)
    while data:
        start = 0
        for at, mark in marks(data, state):
            if isinstance(mark, int):
                state = mark
                continue
            if depth == 0 and mark != b"[":
                raise InvalidValue(f"no JSON array at byte {base + at}")
            after = depth + _DEPTH[mark]
            if (depth == 1 and mark == b",") or after == 0:
                if begin is not None:
                    value = b"".join([*held, data[start:at]]).strip()
                    if value:
                        yield begin, value
                if base >= offset + size:
                    return
                begin = None
            if after == 1 and mark in b"[,":
                begin, held, start = base + at + 1, [], at + 1
            depth = after
        base += len(data)
        if base >= offset + size and begin is None:
            return
        if begin is not None:
            held.append(data[start:])
        data = read(base, step)
    if depth or state != OUTSIDE:
        raise InvalidValue("JSON array without an end")


def _reader(path: str) -> Read:
    store, name = opened(path)
    file = store.open_input_file(name)
    length = file.size()
    return lambda at, size: file.read_at(min(size, length - at), at) if at < length else b""


def read_elements(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, offset, value): each element's JSON text and the byte after the mark before it. Empty files
    and arrays have none; several arrays in one file are read one after the other. A file that is no
    array, or whose array doesn't end, is an error."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}"))).alias("block"))
    tasks = max(1, min(MAX_TASKS, blocks.count() // max(1, TASK_BYTES // block_bytes)))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(64)(_reader)
        for batch in batches:
            found = [summary(read(path_)(int(block) * block_bytes, block_bytes)) for path_, block in zip(batch.path, batch.block, strict=True)]
            yield pd.DataFrame({"path": batch.path, "block": batch.block, "ends": [[e for e, _ in f] for f in found], "depths": [[d for _, d in f] for f in found]})

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        state, depth, out = OUTSIDE, 0, []
        for row in rows.sort_values("block").itertuples(index=False):
            out.append((row.path, row.block, state, depth))
            depth, state = depth + int(row.depths[state]), int(row.ends[state])
        return pd.DataFrame(out, columns=["path", "block", "state", "depth"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(64)(_reader)
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                for at, value in elements(read(row.path), int(row.block) * block_bytes, block_bytes, block_bytes, row.state, row.depth):
                    rows.append((row.path, at, value.decode()))
                    held += len(value)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "offset", "value"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "offset", "value"])

    spread = blocks.repartition(tasks, "path", "block")
    starts = spread.mapInPandas(summarise, "path string, block long, ends array<int>, depths array<long>").groupBy("path").applyInPandas(settle, "path string, block long, state int, depth long")
    return starts.repartition(tasks, "path", "block").mapInPandas(cut, "path string, offset long, value string")


def read_array(spark: SparkSession, path: str, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The elements as rows of schema; one that isn't such an object is an error."""
    found = read_elements(spark, path, block_bytes)
    return found.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_array(rows: DataFrame, path: str) -> None:
    """One JSON array a partition, an element a line."""

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [mark + batch.value.iloc[0], *("," + v for v in batch.value.iloc[1:])]})
                mark = ","
        yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(framed, "value string").write.text(path)
