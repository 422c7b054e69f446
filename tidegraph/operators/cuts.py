"""Nodes and edges whose loss splits a graph, without a sequential search.

A spanning forest is grown breadth first; sizes and the places that edges
outside the forest reach are gathered upwards level by level, and numbers in
preorder are handed downwards.  Where pieces are deeper than ``SHALLOW`` steps, any
spanning forest does instead, numbered along an Euler tour, and there are no rounds by
level at all.  Two forest edges lie on a common cycle as Tarjan
and Vishkin's rules say (1985); the components of that relation are the blocks
of the graph, and everything else is counting.  Pieces of up to ``SMALL`` nodes, which
need no rounds, are walked whole, many of them at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cutting import cut
from ..functions.ranking import running_before
from ..functions.uneven import looked_up
from ..graph import Graph
from ..plans.rounds import fine_parts, staged, tidy
from .components import connected_components, star_components
from .tours import euler_numbers, spanning_edges, subtree_range

#: Levels up to which a forest is grown breadth first.
SHALLOW = 24
#: Nodes of a piece that one task walks whole.
SMALL = 64


def spanning_forest(graph: Graph, pieces: DataFrame, most: int = SHALLOW) -> list[DataFrame] | None:
    """Levels of ``id, parent, root``, from each piece's lowest node outwards; None if there are more than ``most``."""
    steps = staged(graph.both_ways().select("src", "dst"), "steps")
    levels = [
        staged(
            pieces.where("id = lowest").select("id", F.lit(None).cast("bigint").alias("parent"), F.col("id").alias("root")),
            "tree",
        )
    ]
    while True:
        ahead = (
            levels[-1].join(steps, F.col("id") == F.col("src"))
            .groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.min("root").alias("root"))
        )
        for back in levels[-2:]:
            ahead = ahead.join(back.select("id"), "id", "left_anti")
        ahead = staged(ahead, "tree")
        if ahead.isEmpty():
            return levels
        levels.append(ahead)
        if len(levels) > most:
            return None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _numbered(levels: list[DataFrame]) -> list[DataFrame]:
    """Levels with ``size`` of each subtree and ``pre``, its number in preorder."""
    sized = [staged(levels[-1].withColumn("size", F.lit(1).cast("bigint")), "sized")]
    for level in reversed(levels[:-1]):
        below = sized[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
        sized.append(
            staged(
                level.join(below, "id", "left")
                .withColumn("size", 1 + F.coalesce("below", F.lit(0).cast("bigint"))).drop("below"),
                "sized",
            )
        )
    sized.reverse()
    # How much lies at a node's earlier siblings: running totals over all of them, less
    # the parent's first, so that the children of a hub are not met in one task.
    kids = _union(sized).where("parent is not null").select("id", "parent", "size")
    totals = staged(running_before(kids, "parent", "id", amount="size"), "totals")
    first = totals.groupBy("parent").agg(F.min("before").alias("first"))
    skips = staged(totals.join(first, "parent").select("id", (F.col("before") - F.col("first")).alias("skip")), "skips")
    # Numbers are local to a tree: comparisons never leave one.
    out = [staged(sized[0].withColumn("pre", F.lit(0).cast("bigint")), "pre")]
    for level in sized[1:]:
        above = out[-1].select(F.col("id").alias("parent"), F.col("pre").alias("at"))
        out.append(staged(level.join(skips, "id").join(above, "parent").select(
            "id", "parent", "root", "size", (F.col("at") + 1 + F.col("skip")).alias("pre")
        ), "pre"))
    return out


def _outside(graph: Graph, tree: DataFrame) -> DataFrame:
    """``a, b, pre_a, pre_b, apart``: the edges that are not in the forest, and whether neither end is above the other."""
    kin = tree.select("id", F.col("parent").alias("up"), "pre", "size")
    above = "(pre_a <= pre_b and pre_b < pre_a + size_a) or (pre_b <= pre_a and pre_a < pre_b + size_b)"
    return staged(
        graph.edges.select("a", "b")
        .join(kin.toDF("a", "up_a", "pre_a", "size_a"), "a").join(kin.toDF("b", "up_b", "pre_b", "size_b"), "b")
        .where("not (up_a <=> b) and not (up_b <=> a)").select("a", "b", "pre_a", "pre_b", F.expr(f"not ({above})").alias("apart")),
        "outside",
    )


def _reach(outside: DataFrame) -> DataFrame:
    """``id, lo, hi``: the lowest and highest number that edges outside the forest lead to."""
    ends = outside.select(F.col("a").alias("id"), F.col("pre_b").alias("to")).union(outside.select("b", "pre_a"))
    return ends.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))


def _swept(graph: Graph, forest: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``id, parent, root, size, pre, low, high`` by sweeps over the levels, and the edges outside.

    ``low`` and ``high`` are the lowest and highest number that the subtree itself or an
    outside edge from it reaches.
    """
    levels = _numbered(forest)
    outside = _outside(graph, staged(_union(levels), "forest"))
    reach = _reach(outside)
    done: list[DataFrame] = []
    for level in reversed(levels):
        rows = level.join(reach, "id", "left")
        if done:
            below = done[-1].groupBy(F.col("parent").alias("id")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            rows = rows.join(below, "id", "left")
        else:
            rows = rows.withColumn("l", F.lit(None).cast("bigint")).withColumn("h", F.lit(None).cast("bigint"))
        done.append(
            staged(
                rows.select(
                    "id", "parent", "root", "size", "pre",
                    F.least("pre", "lo", "l").alias("low"), F.greatest("pre", "hi", "h").alias("high"),
                ),
                "low",
            )
        )
    return staged(_union(done), "forest"), outside


def _toured(graph: Graph, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for pieces of any depth: one tour of any forest, and minima over rows of its numbers."""
    tree = euler_numbers(pieces, spanning_edges(graph))
    outside = _outside(graph, tree)
    values = _reach(outside).join(tree.select("id", "pre"), "id").select("pre", "lo", "hi")
    ranges = staged(subtree_range(tree.select("id", "pre", "size"), values), "ranges")
    rows = tree.join(ranges, "id", "left").select(
        "id", "parent", "root", "size", "pre", F.least("pre", "low").alias("low"), F.greatest(F.col("pre") + F.col("size") - 1, "high").alias("high")
    )
    return staged(rows, "forest"), outside


def _small_cuts(graph: Graph, pieces: DataFrame) -> tuple[DataFrame, Graph, DataFrame]:
    """``id, stranded, across`` of the pieces of up to ``SMALL`` nodes; the graph and the pieces that are left."""
    with fine_parts(graph.vertices.sparkSession):
        sizes = pieces.groupBy("lowest").agg(F.count("*").alias("n"))
        placed = staged(looked_up(pieces, sizes, "lowest").select("id", "lowest", (F.col("n") <= SMALL).alias("small")), "placed")
        few = placed.where("small").select("id", "lowest")
        edges = graph.edges.select(F.col("a").alias("id"), "b").where("id <> b")
        near = edges.join(few, "id", "left_semi").groupBy("id").agg(F.collect_list("b").alias("near"))
        nodes = few.join(near, "id", "left").select("lowest", F.struct("id", F.coalesce("near", F.array().cast("array<bigint>")).alias("near")).alias("node"))
        whole = nodes.groupBy("lowest").agg(F.collect_list("node").alias("nodes")).select("nodes")
        found = staged(whole.mapInArrow(cut, "id bigint, stranded bigint, across array<bigint>"), "small")
        left = staged(placed.where("not small").select("id", "lowest"), "large")
        rest = staged(graph.edges.select("a", "b").join(left.select(F.col("id").alias("a")), "a", "left_semi"), "edges")
    return found, Graph(left.select("id"), rest.withColumn("weight", F.lit(1.0))), left


@tidy
def cut_structure(
    graph: Graph, shallow: int | None = None, pieces: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(id, stranded)`` for every node, and the bridges ``(a, b)``.

    ``stranded`` is how many nodes lose the largest remaining piece if the node
    goes; it is above 0 exactly for cut vertices.  Where ``shallow`` is given, small pieces
    go by rounds as well.  ``pieces`` are those of the graph, ``id, lowest``, where they are
    known already.
    """
    pieces = staged(connected_components(graph), "pieces") if pieces is None else pieces
    if shallow is not None:
        return _cut_structure(graph, pieces, shallow)
    found, rest, left = _small_cuts(graph, pieces)
    stranded = found.select("id", "stranded")
    bridges = found.select(F.col("id").alias("a"), F.explode("across").alias("b"))
    if left.isEmpty():
        return stranded, bridges
    more = _cut_structure(rest, left, SHALLOW)
    return stranded.union(more[0]), bridges.union(more[1])


def _cut_structure(graph: Graph, pieces: DataFrame, shallow: int) -> tuple[DataFrame, DataFrame]:
    levels = spanning_forest(graph, pieces, shallow)
    tree, outside = _swept(graph, levels) if levels is not None else _toured(graph, pieces)
    up = tree.select(F.col("id").alias("parent"), F.col("parent").alias("grand"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"))
    hung = staged(tree.where("parent is not null").join(up, "parent"), "hung")

    leaves_parent = (F.col("low") < F.col("up_pre")) | (F.col("high") >= F.col("up_pre") + F.col("up_size"))
    together = outside.where("apart").select("a", "b").union(
        hung.where(F.col("grand").isNotNull() & leaves_parent).select("id", "parent")
    )
    blocks = star_components(together)
    # An edge of the forest is named by its lower end.
    placed = hung.join(blocks, F.col("id") == F.col("node"), "left").select(
        "id", "parent", "root", "size", "pre", "low", "high", F.coalesce("component", "id").alias("block")
    )
    placed = staged(placed, "blocks")
    single = (F.col("low") == F.col("pre")) & (F.col("high") < F.col("pre") + F.col("size"))
    bridges = placed.where(single).select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))

    # At v, children of one block stay together; those of v's own block stay with what is above.
    own = placed.select(F.col("id").alias("parent"), F.col("block").alias("own"))
    parts = (
        placed.select("parent", "block", "size").join(own, "parent", "left")
        .where("own is null or own <> block")
        .groupBy("parent", "block").agg(F.sum("size").alias("part"))
        .groupBy("parent").agg(F.sum("part").alias("separated"), F.max("part").alias("largest"))
    )
    pieces = tree.where("parent is null").select("root", F.col("size").alias("piece"))
    rows = tree.select("id", "root").join(pieces, "root").join(parts, F.col("id") == F.col("parent"), "left")
    rest = F.col("piece") - 1 - F.col("separated")
    stranded = rows.select(
        "id",
        F.when(F.col("separated").isNull(), 0)
        .otherwise(F.col("piece") - 1 - F.greatest(F.col("largest"), rest))
        .cast("bigint").alias("stranded"),
    )
    return stranded, bridges


def articulation_points(stranded: DataFrame) -> DataFrame:
    return stranded.where("stranded > 0").select("id").orderBy("id")
