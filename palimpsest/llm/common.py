"""Shared helpers: table access, intermediate tables in the shared folder, safe group keys."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows at most go to a Python worker at once.
BATCH_ROWS = 2_000
#: Keys of more than HOT_ROWS rows, and of a MAX_HOT-th of all, are hot: MAX_HOT at most (some 60 bytes each).
HOT_ROWS, MAX_HOT = 20_000, 50_000
#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. (On a cluster whose
    machines don't have that folder, submit the package with --py-files.) Batches are held to
    BATCH_ROWS, as a batch of whole texts is in memory several times over."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What this Python worker keeps for later tasks of a stage, and that stage.
_KEPT: dict = {}
_KEPT_FOR: list[int | None] = [None]


def kept(key: object, make: Callable[[], object]) -> object:
    """What make gives, kept in the worker for later tasks of the stage (outside tasks: for good)."""
    drop_kept()
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Workers outlive stages: let go of what was kept for another one."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _KEPT_FOR[0] != stage:
        _KEPT_FOR[0] = stage
        if _KEPT:
            _KEPT.clear()
            give_back()


def give_back() -> None:
    """Return to the machine what this process has freed. A worker waits for its next task with what its
    allocators hold, in memory that the executor and its other workers need."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def giving_back(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable:
    """work, for mapInPandas, without what other stages kept in the worker, and giving back at its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_kept()
        yield from work(batches)
        give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where it is unset, a local session (tests) gets a local folder;
    on a cluster there is none that this could choose, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return it reread: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What tells rows apart by identifier and text: columns that with_row_key adds.
ROW_KEY = ("_key_id", "_key_1", "_key_2")


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with ROW_KEY: doc_id and 128 bits of the text's hash."""
    return docs.withColumns(dict(zip(ROW_KEY, (F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), strict=True)))


def without(docs: DataFrame, bad: DataFrame, max_broadcast: int) -> DataFrame:
    """The rows of docs whose ROW_KEY is not among bad's (24 bytes each), nulls being equal."""
    small = bad.limit(max_broadcast + 1).count() <= max_broadcast
    other = bad.select(*[F.col(k).alias(f"{k}_bad") for k in ROW_KEY])
    same = F.lit(True)
    for k in ROW_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_bad"))
    return with_row_key(docs).join(F.broadcast(other) if small else other, same, "left_anti").drop(*ROW_KEY)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; any further columns are ignored, whatever their names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, which have one row a key and the key's number of rows as `size`. Hot
    keys are few by their definition and go by broadcast, so that none of them fills a task. Both
    sides are read twice."""
    least = max(HOT_ROWS, (groups.agg(F.sum(size)).first()[0] or 0) // MAX_HOT)
    hot = groups.filter(F.col(size) > least)
    if hot.isEmpty():
        return rows.join(groups, keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= least), keys, how)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(*cold.columns))
