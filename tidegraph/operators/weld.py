"""Lines welded into a network where their ends meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..graph import Graph
from ..plans.rounds import forget, staged

#: Rounds that settle ends by their neighbours alone, before rows are followed.
DIRECT = 3
_NEAR = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


@dataclass(frozen=True)
class LineNetwork:
    """``nodes(id, x, y, z)`` and ``lines(line_id, from, to, collapsed)``."""

    nodes: DataFrame
    lines: DataFrame

    def graph(self, weights: DataFrame | None = None) -> Graph:
        """Lines as edges: by node-to-node distance, or by ``weights(line_id, weight)``.

        Collapsed lines are left out; of lines between the same nodes the largest
        weight stays.  With ``weights`` every line needs one.
        """
        spark = self.nodes.sparkSession
        kept = self.lines.where("not collapsed")
        if weights is not None:
            told = F.concat_ws(" ", F.lit("line"), "line_id", F.lit("has no weight"))
            given = kept.join(weights.select("line_id", "weight"), "line_id", "left").select(
                "from", "to", F.when(F.col("weight").isNull(), F.raise_error(told).cast("double")).otherwise(F.col("weight")).alias("weight")
            )
            return Graph.of(spark, self.nodes.select("id"), given)
        a = self.nodes.toDF("from", "ax", "ay", "az")
        b = self.nodes.toDF("to", "bx", "by", "bz")
        apart = F.expr("sqrt(pow(bx-ax,2) + pow(by-ay,2) + pow(bz-az,2))")
        return Graph.of(spark, self.nodes.select("id"), kept.join(a, "from").join(b, "to").select("from", "to", apart.alias("weight")))


def _around(boxed: DataFrame) -> DataFrame:
    """Ends in their own cell and in all beside it, as ``ok, ox, oy, oz, c0, c1, c2``."""
    beside = F.array(*[
        F.struct((F.col("c0") + i).alias("c0"), (F.col("c1") + j).alias("c1"), (F.col("c2") + k).alias("c2")) for i, j, k in _NEAR
    ])
    return boxed.select(
        F.col("k").alias("ok"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.inline(beside)
    )


def _along_rows(state: DataFrame) -> DataFrame:
    """``k, maker`` from ``k, maker, waits, lead``: ends that wait for one other alone are settled in rows.

    Such an end is a maker just if that other is none, so what it is follows from any
    end before it and whether an even or odd number of steps lies between.  Steps
    are doubled, as many times as the length of a row has bits.
    """
    rows = staged(state.where("maker is null and waits = 1").select("k", F.col("lead").alias("to"), F.lit(True).alias("flip"), F.lit(True).alias("moved")), "rows")
    while not rows.where("moved").isEmpty():
        on = rows.select(F.col("k").alias("to"), F.col("to").alias("on"), F.col("flip").alias("more"))
        old, rows = rows, staged(rows.join(on, "to", "left").select(
            "k", F.coalesce("on", "to").alias("to"), (F.col("flip") != F.coalesce("more", F.lit(False))).alias("flip"), F.col("on").isNotNull().alias("moved")
        ), "rows")
        forget(old)
    told = rows.join(state.select(F.col("k").alias("to"), F.col("maker").alias("their")), "to").select("k", (F.col("their") != F.col("flip")).alias("told"))
    return state.join(told, "k", "left").select("k", F.coalesce("maker", "told").alias("maker"))


def weld(lines: DataFrame, tolerance: float) -> LineNetwork:
    """Joins line ends that lie within ``tolerance`` of a node made before them.

    ``lines(line_id, ax, ay, az, bx, by, bz)`` are taken in the order of
    ``line_id``, start before end.  An end joins the nearest node that an earlier
    end made, the earliest of equally near ones, or else makes a node where it
    lies.  Chains of close ends are not merged: distances are to a node's maker.

    An end makes a node exactly if no earlier maker is near.  Rounds settle every
    end whose earlier neighbours are settled enough: it is no maker once one of
    them is, and a maker once none of them can be.  Rows of ends, each waiting for
    the one before, are settled at once.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance must be above 0")
    t = float(tolerance)
    places = ["ax", "ay", "az", "bx", "by", "bz"]
    bad = F.lit(False)
    for c in places:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    told = F.concat_ws(" ", F.lit("line"), "line_id", F.lit("has an end that is not finite"))
    checked = lines.select("line_id", F.when(bad, F.raise_error(told).cast("double")).otherwise(F.col("ax").cast("double")).alias("ax"), *[F.col(c).cast("double") for c in places[1:]])
    ends = staged(
        checked.select("line_id", F.explode(F.array(
            F.struct((2 * F.col("line_id")).alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")),
            F.struct((2 * F.col("line_id") + 1).alias("k"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z")),
        )).alias("e")).select("e.*"),
        "ends",
    )
    cells = [F.floor(F.col(c) / t).alias(f"c{i}") for i, c in enumerate("xyz")]
    # Of ends at one place the earliest can be a maker; the others meet makers only.
    boxed = ends.groupBy("x", "y", "z").agg(F.min("k").alias("k")).select("*", *cells)
    around = _around(boxed)
    apart = F.expr("sqrt(pow(x-ox,2) + pow(y-oy,2) + pow(z-oz,2))")
    near = staged(
        boxed.join(around, ["c0", "c1", "c2"]).where("ok < k").where(apart <= t).select("k", F.col("ok").alias("before")), "near"
    )
    state = staged(boxed.select("k", F.lit(None).cast("boolean").alias("maker")), "makers")
    rounds = 0
    while True:
        rounds += 1
        seen = near.join(state.toDF("before", "their"), "before").groupBy("k").agg(
            F.bool_or(F.coalesce("their", F.lit(False))).alias("one"), F.count_if(F.col("their").isNull()).alias("waits"),
            F.min(F.when(F.col("their").isNull(), F.col("before"))).alias("lead"),
        )
        settled = F.coalesce(
            "maker", F.when(F.coalesce("one", F.lit(False)), False).when(F.coalesce("waits", F.lit(0)) == 0, True)
        )
        old, state = state, staged(state.join(seen, "k", "left").select("k", settled.alias("maker"), "waits", "lead"), "makers")
        forget(old)
        if state.where("maker is null").isEmpty():
            break
        if rounds >= DIRECT:
            old, state = state, staged(_along_rows(state), "makers")
            forget(old)
        else:
            state = state.select("k", "maker")
    own = staged(dense_index(state.where("maker").select(F.col("k").alias("id"))).toDF("k", "node"), "nodes")
    # Makers lie further apart than the tolerance, so that a cell holds few of them.
    made = _around(boxed.join(own, "k")).join(own.toDF("ok", "node"), "ok")
    placed = staged(
        ends.select("*", *cells).join(made, ["c0", "c1", "c2"]).where("ok <= k").withColumn("apart", apart).where(F.col("apart") <= t)
        .groupBy("k").agg(F.min(F.struct("apart", "node")).alias("best")).select("k", F.col("best.node").alias("node")),
        "placed",
    )
    nodes = ends.join(own, "k").select(F.col("node").alias("id"), "x", "y", "z")
    half = placed.withColumn("line_id", F.floor(F.col("k") / 2))
    network = half.groupBy("line_id").agg(
        F.max(F.when(F.col("k") % 2 == 0, F.col("node"))).alias("from"), F.max(F.when(F.col("k") % 2 == 1, F.col("node"))).alias("to")
    ).withColumn("collapsed", F.col("from") == F.col("to"))
    return LineNetwork(staged(nodes, "nodes"), staged(network, "lines"))
