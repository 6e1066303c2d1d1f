"""A projection laid out for reads at a clock: facts in cells of a grid over (valid_from, recorded_at).

Both axes are cut at quantiles of the facts, and a fact's cell interleaves the bits of its two steps, so that
facts near each other on both axes are in neighbouring folders. A small table keeps for each cell the least
valid_from and recorded_at, the greatest valid_until and the number of rows. A read at a clock picks the cells that
may hold a fact known and valid then from that table, and Spark prunes the other folders: an early clock reads a
fraction of the files.

What replaces a fact and its last retraction stand on the fact's own row (as in streaming.projection_store), so the
read is a filter without an anti-join. Nodes are laid out by recorded_at alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.errors import InvalidValue
from palimpsest.operators.view import Projection, View, is_current
from palimpsest.sources.storage import materialize


CELL_FACT = f"{schema.STORED_FACT}, replaced array<struct<replaced_from:bigint,replaced_at:bigint>>, ended array<struct<ended_until:bigint,ended_at:bigint>>, cell int"


def _step(c: str, cuts: list[int]) -> Column:
    """How many of the cuts are not above the value."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= F.col(c)))


def _interleaved(a: Column, b: Column, bits: int) -> Column:
    out = F.lit(0)
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, i).bitwiseAND(1), 2 * i + 1)).bitwiseOR(F.shiftleft(F.shiftright(b, i).bitwiseAND(1), 2 * i))
    return out


def _cuts(rows: DataFrame, column: str, steps: int) -> list[int]:
    """Distinct quantiles of a column, fewer than steps."""
    found = rows.select(F.percentile_approx(column, [i / steps for i in range(1, steps)], 10_000)).first()[0] or []
    return sorted(set(found))


class ClusteredProjection:
    """The layout below a folder; write() makes it, view() and active_facts() read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def write(projection: Projection, path: str, bits: int = 3) -> ClusteredProjection:
        """bits: of each axis, so there are 4**bits cells at most."""
        if not 0 <= bits <= 6:
            raise InvalidValue("clustered projection: bits must be from 0 to 6")
        out = ClusteredProjection(projection.facts.sparkSession, path)
        facts = materialize(projection.facts, "facts")
        replaced = projection.supersessions.select(F.col("prior").alias("id"), F.col("valid_from").alias("replaced_from"), F.col("recorded_at").alias("replaced_at"))
        ended = projection.retractions.select(F.col("fact_id").alias("id"), F.col("valid_until").alias("ended_until"), F.col("recorded_at").alias("ended_at"))
        # A fact has one replacement and one last retraction at most; a projection that was never checked may have more.
        replaced = replaced.groupBy("id").agg(F.collect_set(F.struct("replaced_from", "replaced_at")).alias("replaced"))
        ended = ended.groupBy("id").agg(F.collect_set(F.struct("ended_until", "ended_at")).alias("ended"))
        cell = _interleaved(_step("valid_from", _cuts(facts, "valid_from", 1 << bits)), _step("recorded_at", _cuts(facts, "recorded_at", 1 << bits)), bits)
        rows = facts.join(replaced, "id", "left").join(ended, "id", "left").withColumn("cell", cell)
        # A cell that outgrows a task is written as several files.
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{out.path}/facts")
        least = [F.min(c).alias(c) for c in ("valid_from", "recorded_at")]
        until = F.max(F.coalesce("valid_until", F.lit(2**63 - 1))).alias("valid_until")
        out._facts().groupBy("cell").agg(*least, until, F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{out.path}/cells")
        steps = _step("recorded_at", _cuts(projection.node_revisions, "recorded_at", 1 << bits))
        projection.node_revisions.withColumn("step", steps).hint("rebalance", "step").write.partitionBy("step").parquet(f"{out.path}/nodes")
        out._nodes().groupBy("step").agg(F.min("recorded_at").alias("recorded_at")).coalesce(1).write.parquet(f"{out.path}/steps")
        return out

    def _facts(self) -> DataFrame:
        return self.spark.read.schema(CELL_FACT).parquet(f"{self.path}/facts")

    def _nodes(self) -> DataFrame:
        return self.spark.read.schema(f"{schema.NODE_REVISION}, step int").parquet(f"{self.path}/nodes")

    def cells(self, valid_at: int, known_at: int) -> list[int]:
        """The cells that may hold a fact known and valid at the clock: of 4**bits at most."""
        may = (F.col("recorded_at") <= known_at) & (F.col("valid_from") <= valid_at) & (F.col("valid_until") > valid_at)
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/cells").filter(may).select("cell").collect())

    def active_facts(self, valid_at: int, known_at: int) -> DataFrame:
        rows = self._facts().filter(F.col("cell").isin(self.cells(valid_at, known_at))).filter(is_current(valid_at, known_at))
        replaced = F.coalesce(F.exists("replaced", lambda r: (r["replaced_at"] <= known_at) & (r["replaced_from"] <= valid_at)), F.lit(False))
        ended = F.coalesce(F.exists("ended", lambda r: (r["ended_at"] <= known_at) & (r["ended_until"] <= valid_at)), F.lit(False))
        return rows.filter(~replaced & ~ended).drop("cell", "replaced", "ended")

    def visible_nodes(self, known_at: int) -> DataFrame:
        steps = [r[0] for r in self.spark.read.parquet(f"{self.path}/steps").filter(F.col("recorded_at") <= known_at).select("step").collect()]
        rows = self._nodes().filter(F.col("step").isin(steps)).drop("step")
        return Projection(rows, rows, rows, rows).visible_nodes(known_at)

    def view(self, valid_at: int, known_at: int) -> View:
        """As Projection.view."""
        nodes, facts = self.visible_nodes(known_at), self.active_facts(valid_at, known_at)
        ids = nodes.select("id")
        for end in ("source", "target"):
            facts = facts.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return View(nodes, facts)
