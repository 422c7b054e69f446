"""Trees that hang from a graph, taken off before paths are followed; nothing is lost by it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uneven import looked_up
from ..graph import Graph
from ..plans.rounds import staged
from .components import connected_components

#: Rounds go on while one node in so many hangs by a single edge.
SHARE = 8
_LOADS = ("own", "size", "seeds", "cross", "deep")


@dataclass(frozen=True)
class Trimmed:
    """What is left of a graph, and the nodes that were taken off with their trees.

    ``loads(id, own, size, seeds, cross, deep)`` has the nodes of ``core``: whether a node is an
    origin itself, the nodes and the origins of the tree it carries, itself included, the sum
    over its branches of their nodes times their origins, and the steps from it to its origins.
    ``peeled`` has the same and ``parent`` for those taken off, a table a round.
    """

    core: Graph
    loads: DataFrame
    peeled: tuple[DataFrame, ...]

    def every_load(self) -> DataFrame:
        out = self.loads.select("id", *_LOADS)
        for gone in self.peeled:
            out = out.union(gone.select("id", *_LOADS))
        return out

    @cached_property
    def pieces(self) -> DataFrame:
        """``id, lowest`` of the core's nodes, found once for all that asks for it."""
        return staged(connected_components(self.core), "pieces")

    def totals(self) -> DataFrame:
        """``id, whole, asked, depths`` of the core's nodes: the nodes, origins and steps to origins of their piece."""
        pieces = self.pieces
        sums = pieces.join(self.loads, "id").groupBy("lowest").agg(
            F.sum("size").alias("whole"), F.sum("seeds").alias("asked"), F.sum("deep").alias("depths")
        )
        return looked_up(pieces, sums, "lowest").select("id", "whole", "asked", "depths")

    def handed_down(self, known: DataFrame, **changed: Column) -> DataFrame:
        """``known`` of the core's nodes and of those taken off, from their parents'; ``changed`` on the way."""
        names = [c for c in known.columns if c != "id"]
        known = staged(known, "known")
        for gone in reversed(self.peeled):
            rows = looked_up(gone, known.withColumnRenamed("id", "parent"), "parent")
            below = rows.select("id", *[changed.get(c, F.col(c)).alias(c) for c in names])
            known = known.union(staged(below, "known"))
        return known


def trim(graph: Graph, origins: DataFrame) -> Trimmed:
    """Takes off nodes with one edge, again and again while they are many.

    Each hands its load to its neighbour; of two nodes that have only each other the lower
    stays.  Stopping early, as on a long chain, leaves a larger core and the same results.
    """
    edges = staged(graph.edges.select("a", "b"), "edges")
    own = origins.select(F.col("origin").alias("id"), F.lit(1).cast("bigint").alias("own"))
    none = F.lit(0).cast("bigint")
    loads = graph.vertices.join(own, "id", "left").select(
        "id", F.coalesce("own", none).alias("own"), F.lit(1).cast("bigint").alias("size"),
        F.coalesce("own", none).alias("seeds"), none.alias("cross"), none.alias("deep"),
    )
    peeled = []
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        degree = staged(ends.groupBy("id").agg(F.count("*").alias("k"), F.min("other").alias("other")), "degree")
        told = degree.agg(F.count("*").alias("nodes"), F.count_if(F.col("k") == 1).alias("leaves")).first()
        if told["leaves"] == 0 or told["leaves"] * SHARE < told["nodes"]:
            break
        # Both ends of an edge may be leaves: the group holds both, and the higher goes.
        gone = degree.where("k = 1").groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("id").alias("id"))
        gone = staged(gone.select("a", "b", "id", F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent")), "gone")
        edges = staged(edges.join(gone.select("a", "b"), ["a", "b"], "left_anti"), "edges")
        held = staged(loads.join(gone.select("id", "parent"), "id", "left"), "held")
        given = held.where("parent is not null")
        peeled.append(given)
        moved = given.select(
            F.col("parent").alias("id"), none.alias("own"), "size", "seeds",
            (F.col("size") * F.col("seeds")).alias("cross"), (F.col("deep") + F.col("seeds")).alias("deep"),
        )
        loads = held.where("parent is null").select("id", *_LOADS).union(moved).groupBy("id").agg(*[F.sum(c).alias(c) for c in _LOADS])
    loads = staged(loads, "loads") if peeled else loads
    core = Graph(loads.select("id"), edges.withColumn("weight", F.lit(1.0))) if peeled else Graph(graph.vertices, edges.withColumn("weight", F.lit(1.0)))
    return Trimmed(core, loads, tuple(peeled))
