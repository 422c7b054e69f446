"""A graph as DataFrames: a table of vertices and one of edges or arcs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranking import running_before


class Duplicates(Enum):
    """What becomes of several weighted arcs from one node to another."""

    KEEP_SMALLEST = "min"
    KEEP_LARGEST = "max"
    SUM = "sum"

    def of(self, column: str) -> Column:
        return getattr(F, self.value)(column)


def _vertices(spark: SparkSession, vertices: int | DataFrame) -> DataFrame:
    if isinstance(vertices, int):
        if vertices < 1:
            raise ValueError("a graph needs at least one node")
        return spark.range(vertices)
    return vertices.select(F.col(vertices.columns[0]).cast("bigint").alias("id")).distinct()


def _checked(pairs: DataFrame, vertices: int | DataFrame, negative: bool) -> DataFrame:
    """``pairs`` whose weight raises an error where a pair is not allowed.

    The check sits in the weight itself, so column pruning cannot drop it.
    """
    src, dst, w = F.col("src"), F.col("dst"), F.col("weight")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    if not negative:
        bad = bad | (w < 0)
    out = F.lit(False)
    if isinstance(vertices, int):
        out = (src < 0) | (dst < 0) | (src >= vertices) | (dst >= vertices)
    out = out | src.isNull() | dst.isNull()
    told = F.concat_ws(" ", F.lit("edge"), src, dst, F.lit("has a node or a weight that is not allowed:"), w)
    return pairs.withColumn("weight", F.when(out | bad, F.raise_error(told).cast("double")).otherwise(w))


def _pairs(pairs: DataFrame) -> DataFrame:
    names = pairs.columns
    weight = F.col(names[2]).cast("double") if len(names) > 2 else F.lit(1.0)
    return pairs.select(
        F.col(names[0]).cast("bigint").alias("src"), F.col(names[1]).cast("bigint").alias("dst"), weight.alias("weight")
    )


@dataclass(frozen=True)
class Graph:
    """Undirected: ``vertices(id)`` and ``edges(a, b, weight)`` with a < b, once each."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(spark: SparkSession, vertices: int | DataFrame, pairs: DataFrame) -> Graph:
        """From ``(a, b[, weight])`` rows in either order.

        A pair given several times keeps its largest weight; self-loops and
        weights of zero are dropped; negative, missing, NaN and infinite weights
        and, for a node count, ids outside ``0..n-1`` raise an error when read.
        """
        checked = _checked(_pairs(pairs), vertices, negative=False)
        edges = (
            checked.where("src <> dst and weight <> 0")
            .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            .agg(F.max("weight").alias("weight"))
        )
        return Graph(_vertices(spark, vertices), edges)

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("a", "b")

    def both_ways(self) -> DataFrame:
        """``(src, dst, weight)`` from both ends of every edge."""
        e = self.edges
        return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(
            e.select("b", "a", "weight")
        )

    steps = both_ways

    def node_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def neighbours(self, node: int) -> DataFrame:
        return self.both_ways().where(F.col("src") == node).select("dst", "weight").orderBy("dst")

    def degree(self) -> DataFrame:
        """``id, degree``: the sum of weights at each node, 0 where there is none."""
        sums = self.both_ways().groupBy("src").agg(F.sum("weight").alias("degree"))
        return self.vertices.join(sums, F.col("id") == F.col("src"), "left").select(
            "id", F.coalesce("degree", F.lit(0.0)).alias("degree")
        )

    def reweight(self, weight: Column) -> Graph:
        """New weights from an expression over ``a``, ``b``, ``weight``; those not above 0 go."""
        told = F.concat_ws(" ", F.lit("new weight of edge"), "a", "b", F.lit("is not finite"))
        fresh = self.edges.withColumn("weight", weight.cast("double"))
        bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf"))
        checked = fresh.withColumn("weight", F.when(bad, F.raise_error(told).cast("double")).otherwise(F.col("weight")))
        return Graph(self.vertices, checked.where("weight > 0"))

    def directed(self) -> DiGraph:
        """An arc each way for every edge."""
        return DiGraph(self.vertices, self.both_ways())

    def weight_of(self, pairs: DataFrame) -> DataFrame:
        """``pairs(src, dst)`` with the weight of the edge between them, null if none."""
        edges = self.edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "weight")
        on = (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b"))
        return pairs.select("src", "dst").join(edges, on, "left").select("src", "dst", "weight")

    def propagate(self, signal: DataFrame, columns: Iterable[str], self_weight: float = 1.0) -> DataFrame:
        """``id`` and ``columns`` after one normalised step: D^-1/2 (A + sI) D^-1/2 x.

        D counts the self weight s; a node without weight gets zeros.
        """
        if not self_weight >= 0:
            raise ValueError("the self weight must not be negative or NaN")
        columns = list(columns)
        total = F.col("degree") + F.lit(float(self_weight))
        scales = self.degree().select("id", F.when(total > 0, 1 / F.sqrt(total)).otherwise(0.0).alias("scale"))
        scaled = signal.join(scales, "id").select(
            "id", "scale", *[(F.col(c) * F.col("scale")).alias(c) for c in columns]
        )
        own = scaled.select("id", *[(F.col(c) * self_weight).alias(c) for c in columns])
        near = (
            self.both_ways().join(scaled.drop("scale").withColumnRenamed("id", "src"), "src")
            .select(F.col("dst").alias("id"), *[(F.col(c) * F.col("weight")).alias(c) for c in columns])
        )
        sums = own.union(near).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
        return sums.join(scales, "id").select("id", *[(F.col(c) * F.col("scale")).alias(c) for c in columns])


@dataclass(frozen=True)
class DiGraph:
    """Directed: ``vertices(id)`` and ``arcs(src, dst, weight)``, once for each direction."""

    vertices: DataFrame
    arcs: DataFrame

    @staticmethod
    def of(
        spark: SparkSession, vertices: int | DataFrame, pairs: DataFrame, duplicates: Duplicates | None = None
    ) -> DiGraph:
        """From ``(src, dst[, weight])`` rows; weights need a policy for duplicates.

        Self-loops are dropped; zero and negative weights stay; missing, NaN and
        infinite ones and, for a node count, ids out of range raise when read.
        """
        weighted = len(pairs.columns) > 2
        if weighted and not isinstance(duplicates, Duplicates):
            raise ValueError("weighted arcs need a policy for duplicates")
        rule = duplicates if weighted else Duplicates.KEEP_LARGEST
        checked = _checked(_pairs(pairs), vertices, negative=True).where("src <> dst")
        arcs = checked.groupBy("src", "dst").agg(rule.of("weight").alias("weight"))
        return DiGraph(_vertices(spark, vertices), arcs)

    def ordered_arcs(self) -> DataFrame:
        return self.arcs.orderBy("src", "dst")

    def steps(self) -> DataFrame:
        return self.arcs

    def node_count(self) -> int:
        return self.vertices.count()

    def arc_count(self) -> int:
        return self.arcs.count()

    def first_arcs(self) -> DataFrame:
        """``id, first_arc``: how many arcs leave nodes with a smaller id."""
        out = self.arcs.groupBy("src").agg(F.count("*").alias("n"))
        rows = self.vertices.join(out, F.col("id") == F.col("src"), "left").select(
            "id", F.coalesce("n", F.lit(0)).alias("n")
        )
        return running_before(rows, name="first_arc").select("id", "first_arc")

    def with_arc_ids(self) -> DataFrame:
        """``src, dst, weight, arc_id``: positions in the order of tail, then head."""
        numbered = running_before(self.arcs.withColumn("n", F.lit(1)), "src", "dst", name="arc_id")
        return numbered.select("src", "dst", "weight", "arc_id")

    def weight(self, arc_id: int) -> DataFrame:
        return self.with_arc_ids().where(F.col("arc_id") == arc_id).select("weight")

    def successors(self, node: int) -> DataFrame:
        return self.arcs.where(F.col("src") == node).select("dst", "weight").orderBy("dst")

    def predecessors(self, node: int) -> DataFrame:
        return self.with_arc_ids().where(F.col("dst") == node).select("src", "weight", "arc_id").orderBy("src")

    def undirected(self, duplicates: Duplicates) -> Graph:
        """Arc and reverse folded by the policy first; then an undirected graph's rules."""
        folded = self.arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
            duplicates.of("weight").alias("weight")
        )
        return Graph.of(self.arcs.sparkSession, self.vertices, folded)

    def weight_of(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("src", "dst").join(self.arcs, ["src", "dst"], "left")


AnyGraph = Graph | DiGraph
CostOf = Callable[[Column, Column, Column], Column]
