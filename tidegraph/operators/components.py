"""Connected pieces of an undirected graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uneven
from ..functions.ranking import dense_index
from ..functions.uneven import looked_up
from ..graph import Graph
from ..plans.rounds import fine_parts, staged


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return looked_up(edges.toDF("above", "u"), low, "u", often=hubs).select(F.col("above").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hubs: list) -> DataFrame:
    """A node and its neighbours below it move to the smallest of these; an edge gives one edge."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return looked_up(edges, low, "u", often=hubs).select(moved.alias("u"), F.col("m").alias("v")).distinct()


def _standing(edges: DataFrame) -> tuple[bool, list]:
    """Whether every edge ends at a root: no node has two edges down, or one down and one up.  And nodes with very many edges."""
    ends = edges.select(
        F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down"))))
    )
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.min("down").alias("least"), F.count("*").alias("k"))
    told = nodes.agg(F.count_if(F.col("down") > F.col("least")).alias("moving"), F.collect_list(F.when(F.col("k") > uneven.MANY, F.col("n"))).alias("hubs")).first()
    return not told["moving"], told["hubs"]


def star_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """``node, component`` for every node on an edge; component is its smallest node.

    Alternates large-star and small-star rounds (Kiveris et al., 2014), about
    log2(n) of them, until every edge ends at the root of a star; ``save`` keeps
    the edges between one round and the next.  Minima are pre-aggregated and
    joined back, and edges of a node with very many of them, as a root in the end, stay
    where they lie, so that a hub is never gathered in one place.  The columns may
    be of any orderable type; self-loops, repeats and nulls are ignored; no
    edges give no rows.
    """
    pairs = edges.toDF("x", "y").where("x <> y")
    down = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    with fine_parts(edges.sparkSession):
        now = save(down.distinct())
        while True:
            standing, hubs = _standing(now)
            if standing:
                break
            # A large star keeps the upper ends, so the same nodes have very many edges in the small one.
            now = save(_small_star(_large_star(now, hubs), hubs))
    return now.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))
    ))).distinct()


def connected_components(graph: Graph) -> DataFrame:
    """``id, lowest``: the smallest node of each node's piece; isolated nodes included."""
    found = star_components(graph.edges.select("a", "b"))
    return graph.vertices.join(found, F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("component", "id").alias("lowest")
    )


def _kept(pieces: DataFrame) -> DataFrame:
    with fine_parts(pieces.sparkSession):
        return staged(pieces, "pieces")


def numbered_components(graph: Graph) -> DataFrame:
    """``id, component``: pieces numbered 0, 1, ... in the order of their lowest nodes."""
    found = _kept(connected_components(graph))
    roots = dense_index(found.where("id = lowest").select("id"))
    return looked_up(found, roots.toDF("lowest", "component"), "lowest").select("id", "component")


def piece_sizes(pieces: DataFrame, column: str = "component") -> DataFrame:
    """``id, piece_size`` from ``id`` and a piece column, pre-aggregated by piece."""
    pieces = _kept(pieces.select("id", column))
    sizes = pieces.groupBy(column).agg(F.count("*").alias("piece_size"))
    return looked_up(pieces, sizes, column).select("id", "piece_size")


def reached_from(graph: Graph, nodes: DataFrame) -> DataFrame:
    """``id, reached``: whether the node's piece holds one of ``nodes(id)``."""
    found = _kept(connected_components(graph))
    lit = found.join(nodes.select("id"), "id", "left_semi").select("lowest").distinct().withColumn("hit", F.lit(True))
    return looked_up(found, lit, "lowest", "left").select("id", F.coalesce("hit", F.lit(False)).alias("reached"))
