"""The shared folder: where intermediate tables end lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a local folder; a cluster's machines
    share no folder that this could choose, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidValue("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in a task, and the path there."""
    if re.match(r"^\w+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return it reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that sorts, joins or groups.
TASK_ROWS = 100_000


def tasks_for(df: DataFrame) -> int:
    """So many tasks that each holds about TASK_ROWS rows of df. Spark sizes tasks by compressed bytes, in which rows
    of ids and repeated texts shrink to a thirtieth of what they take when they are sorted or hashed."""
    return max(1, -(-df.count() // TASK_ROWS))


def _place() -> Column:
    """A row's place in its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _part and _row: a range of the order, and the place in it. Both stay as they are once this is written."""
    ranged = df.repartitionByRange(tasks_for(df), *order).sortWithinPartitions(*order)
    return ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", _place())


def with_positions(df: DataFrame, order: list[str], name: str = "position", base: int = 0, group: str | None = None, group_name: str = "group_position") -> DataFrame:
    """Contiguous positions in a total order, without one task for all rows: rows are range
    partitioned and sorted, and each partition starts where the ones before it end. With a group
    column, also positions within each group, in the same order: a group may hold all rows."""
    ranged = in_ranges(df, order)
    if group:
        # Sorted again where they are, a group's rows of a partition stand together, still in order.
        ranged = ranged.sortWithinPartitions(group, "_row").withColumn("_place", _place())
    held = materialize(ranged, "ordered")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition: a few thousand at most.
    lists = counts.agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("_all"))
    before = F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    starts = counts.crossJoin(F.broadcast(lists)).select("_part", before.alias("_before"))
    rows = held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_row") + base)
    if group:
        # A window holds a group's counts, one a partition.
        earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = held.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        sums = sums.select("_part", group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_ahead"))
        rows = rows.join(sums, ["_part", group]).withColumn(group_name, F.col("_ahead") + F.col("_place")).drop("_ahead", "_place")
    return rows.drop("_part", "_row", "_before")


def _digest_sums(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df with two hashes of each row (maps by sorted entries), and what a digest holds of them."""
    flat = [F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in sorted(df.dtypes)]
    row = F.to_json(F.struct(*flat))
    # Bound by a lambda, a row's text is made once for both hashes.
    both = F.transform(F.array(row), lambda text: F.struct(*[F.xxhash64(F.lit(seed), text).alias(f"h{seed}") for seed in (1, 2)]))[0]
    hashed = df.withColumn("_digest", both)
    return hashed, [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_digest.h{seed}").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]]


def content_digest(df: DataFrame) -> str:
    """Independent of the order of rows: count, and the sums of two row hashes."""
    hashed, sums = _digest_sums(df)
    return ":".join(str(x) for x in hashed.agg(*sums).first())


def write_digested(df: DataFrame, path: str, block: int) -> str:
    """Write df with row groups of block bytes, and return the digest of its content, taken in the same pass."""
    hashed, sums = _digest_sums(df)
    told = Observation()
    hashed.observe(told, *sums).drop("_digest").write.option("parquet.block.size", block).parquet(path)
    return ":".join(str(told.get[c]) for c in ("n", "h1", "h2"))
