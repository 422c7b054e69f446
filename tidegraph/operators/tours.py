"""Forests of any depth: spanning edges, Euler tours numbered by list ranking, minima over subtrees.

Nothing here has a round for a level of the tree.  The number of rounds follows
the logarithm of the number of nodes, however long a path is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running_before
from ..graph import Graph
from ..plans.rounds import forget, staged, tidy
from .chains import ranked_lists
from .components import star_components

#: Neighbours of a node that one task puts in order.
BUCKET_ROWS = 20_000


@tidy
def spanning_edges(graph: Graph) -> DataFrame:
    """``a, b``: edges that join every piece without closing a circle (Boruvka's rounds).

    Every group of nodes takes its lightest edge out, an edge's weight being a hash of
    its ends, so that groups at least halve and are short chains of old ones, whatever
    the graph looks like.  No two edges weigh the same, so none closes a circle.
    """
    weight = F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("w")
    now = staged(graph.edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), weight), "between")
    chosen: list[DataFrame] = []
    while not now.isEmpty():
        both = now.select(F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))
        # The lightest way out of u, and where it leads.
        out = both.groupBy("u").agg(F.min(F.struct("w", "v")).alias("m")).select("u", "m.v", "m.w")
        taken = staged(out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").distinct(), "taken")
        chosen.append(taken.select("w.a", "w.b"))
        if len(chosen) > 8:
            chosen = [staged(_union(chosen), "chosen")]
        group = staged(star_components(taken.select("u", "v")), "groups")
        moved = now.join(group.toDF("u", "gu"), "u").join(group.toDF("v", "gv"), "v").where("gu <> gv")
        # Of the edges between two groups only the lightest can be taken.
        left = moved.groupBy(F.least("gu", "gv").alias("u"), F.greatest("gu", "gv").alias("v")).agg(F.min("w").alias("w"))
        old, now = now, staged(left, "between")
        forget(old, group)
    return _union(chosen) if chosen else graph.edges.where("false").select("a", "b")


def _next_around(arcs: DataFrame) -> DataFrame:
    """``id, after``: the arc behind each one in a circle around the node both leave.

    A node's arcs are put in order in buckets, as many as its degree asks for, and
    the buckets are joined end to start; so no task orders all arcs of a hub.
    """
    degree = arcs.groupBy("src").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("k"))
    dealt = arcs.join(degree, "src").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("k"))).select("id", "src", "bucket")
    inside = Window.partitionBy("src", "bucket").orderBy("id")
    ordered = staged(dealt.withColumn("after", F.lead("id").over(inside)), "around")
    firsts = ordered.groupBy("src", "bucket").agg(F.min("id").alias("first"))
    around = Window.partitionBy("src").orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("src", "bucket", F.coalesce(F.lead("first").over(around), F.first("first").over(whole)).alias("start"))
    last = ordered.where("after is null").join(ends, ["src", "bucket"]).select("id", F.col("start").alias("after"))
    return ordered.where("after is not null").select("id", "after").union(last)


@tidy
def euler_numbers(pieces: DataFrame, tree: DataFrame) -> DataFrame:
    """``id, parent, root, pre, size`` from ``id, lowest`` and the edges ``a, b`` of a forest.

    Roots are the lowest nodes.  An edge is walked down and up; from an arc into a
    node the walk goes on along the arc behind the one back.  Places on the walk come from
    list ranking, and ``pre`` counts the nodes entered before, over all trees: a
    subtree holds the numbers from ``pre`` up to, not including, ``pre + size``.
    """
    edges = staged(tree.select((2 * F.monotonically_increasing_id()).alias("e"), "a", "b"), "tree")
    arcs = staged(edges.select(F.inline(F.array(
        F.struct(F.col("e").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct((F.col("e") + 1).alias("id"), F.col("b").alias("src"), F.col("a").alias("dst")),
    ))), "arcs")
    walk = staged(_next_around(arcs).select(F.col("id").bitwiseXOR(F.lit(1).cast("bigint")).alias("id"), F.col("after").alias("next")), "walk")
    # Each walk begins at the first arc out of its root.
    roots = pieces.where("id = lowest").select(F.col("id").alias("src"))
    begins = staged(arcs.join(roots, "src", "left_semi").groupBy("src").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("start")), "begins")
    opened = walk.join(begins.withColumnRenamed("id", "next"), "next", "left").select("id", F.when(F.col("start").isNull(), F.col("next")).alias("next"))
    opened = staged(opened, "opened")
    back = opened.where("next is not null").select(F.col("next").alias("id"), F.col("id").alias("prev"))
    none = F.lit(None).cast("bigint")
    ranks = ranked_lists(opened.join(back, "id", "left").select("id", "prev", "next", none.alias("first"), none.alias("last"), F.lit(1).alias("weight")))
    # The farther an arc is from the end, the earlier it is walked.
    placed = staged(arcs.join(ranks.select("id", "rank"), "id").join(
        pieces.select(F.col("id").alias("src"), F.col("lowest").alias("root")), "src"
    ).select("id", "src", "dst", "root", "rank"), "placed")
    paired = placed.groupBy(F.shiftright("id", 1).alias("e"), "root").agg(
        F.max(F.struct("rank", "src", "dst")).alias("down"), F.min("rank").alias("up")
    )
    entered = paired.select(
        "root", F.col("down.dst").alias("id"), F.col("down.src").alias("parent"), (-F.col("down.rank")).alias("at"),
        ((F.col("down.rank") - F.col("up") + 1) / 2).cast("bigint").alias("size"), F.lit(1).alias("n"),
    )
    # A root comes before all arcs of its tree; it holds what no one else does not.
    sizes = pieces.groupBy("lowest").agg(F.count("*").alias("size"))
    first = sizes.select(
        F.col("lowest").alias("root"), F.col("lowest").alias("id"), none.alias("parent"), F.lit(-(2**62)).cast("bigint").alias("at"),
        "size", F.lit(1).alias("n"),
    )
    return running_before(first.union(entered), "root", "at", name="pre").select("id", "parent", "root", "pre", "size")


def _levels(below: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(below + 1)).cast("int"))


def subtree_range(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``id, low, high``: the least ``lo`` and the greatest ``hi`` over each subtree.

    ``nodes`` is ``id, pre, size``; ``values`` is ``pre, lo, hi``, for some nodes.
    Numbers are gathered in blocks of 1, 2, 4, ... of them, in one sum that shrinks
    where it is made; a subtree is a row of numbers and is cut into at most two
    blocks of each size.  Subtrees without values give no row.
    """
    top = nodes.agg(F.max("pre")).first()[0] or 0
    blocks = values.select("lo", "hi", "pre", F.explode(_levels(F.lit(top))).alias("k")).groupBy(
        "k", F.expr("shiftright(pre, k)").alias("block")
    ).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # At each size: the first block begins at or behind the start, the last ends at or before the end.
    parts = nodes.select("id", "pre", (F.col("pre") + F.col("size")).alias("end"), F.explode(_levels(F.col("size"))).alias("k")).selectExpr(
        "id", "k", "shiftright(pre + shiftleft(1L, k) - 1, k) AS l", "shiftright(end, k) AS r"
    ).where("l < r")
    asked = parts.select("id", "k", F.explode(F.array_compact(F.array(
        F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)
    ))).alias("block"))
    return asked.join(blocks, ["k", "block"]).groupBy("id").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out
