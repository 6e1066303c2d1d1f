"""Order-dependent work without a window over a whole group: rows are range partitioned and sorted by group and
order, each partition is worked on alone, and what a group carries from one partition into the next is handed on.

A group may hold all rows: it is then spread over all partitions. Only the first group of a partition can begin in
one before, so what is handed on is one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.storage import materialize


def in_order(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows with _part and _row: their partition and their place in it, in the order of keys and order; written once,
    so that both stay as they are. Rows of equal keys and order may be in either of two neighbouring partitions."""
    columns = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return materialize(numbered, "in-order")


def carried(ordered: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """ordered (of in_order) with `_carried`: the last non-null value of the row's group before the row."""
    own = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    valued = ordered.withColumn("_value", value)
    rows = valued.withColumn("_before", F.last("_value", ignorenulls=True).over(own))
    firsts = ordered.groupBy("_part").agg(F.min_by(F.struct(*keys), "_row").alias("_group"))
    # The last value of each group in each partition in which it isn't the only group that matters: those groups
    # that some partition begins with.
    held = valued.filter(F.col("_value").isNotNull()).withColumn("_group", F.struct(*keys))
    begun = firsts.select(F.col("_group"), F.col("_part").alias("_into"))
    tails = held.join(F.broadcast(begun.select("_group").distinct()), "_group", "left_semi").groupBy("_group", "_part").agg(F.max_by("_value", "_row").alias("_tail"))
    # Of a partition's first group the nearest partition before that has a value: at most a row for each two partitions
    # that one group fills, so the nearest is found by a window over the group's partitions.
    both = tails.select("_group", "_part", "_tail").unionByName(begun.select("_group", F.col("_into").alias("_part"), F.lit(None).alias("_tail")), allowMissingColumns=True)
    both = both.groupBy("_group", "_part").agg(F.first("_tail", ignorenulls=True).alias("_tail"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = both.withColumn("_handed", F.last("_tail", ignorenulls=True).over(earlier)).select("_group", "_part", "_handed").filter("_handed IS NOT NULL")
    rows = rows.withColumn("_group", F.struct(*keys)).join(F.broadcast(handed), ["_group", "_part"], "left")
    return rows.withColumn("_carried", F.coalesce("_before", "_handed")).drop("_value", "_before", "_handed", "_group")
