"""Potentials of a flow: the graph's Laplacian solved by conjugate gradients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.rounds import forget, measured, staged
from .components import reached_from


@dataclass(frozen=True)
class PotentialFlow:
    """``potentials(id, potential, reached)``; null where no drain is reached."""

    potentials: DataFrame
    iterations: int
    converged: bool


def potential_flow(
    graph: Graph, injected: DataFrame, grounded: DataFrame, tolerance: float = 1e-10, limit: int | None = None
) -> PotentialFlow:
    """Potentials for ``injected(id, amount)`` that drains at ``grounded(id)``, held at 0.

    Pieces without a drain stay unreached; what is injected there, or at a
    drain, is ignored.  The solver takes conjugate gradients, preconditioned by the
    degrees, in the form with one reduction (Chronopoulos and Gear, 1989): a round is one
    join of steps with the residual, one write, and no other job.
    """
    reach = reached_from(graph, grounded)
    free = reach.where("reached").join(grounded.select("id"), "id", "left_anti").select("id")
    base = graph.degree().join(free, "id").join(
        injected.groupBy("id").agg(F.sum("amount").alias("b")), "id", "left"
    ).select("id", "degree", F.coalesce("b", F.lit(0.0)).cast("double").alias("b"))
    base = staged(base, "base")
    steps = staged(
        graph.both_ways().join(free.toDF("src"), "src", "left_semi").join(free.toDF("dst"), "dst", "left_semi"), "steps"
    )
    # One pass a round: the steps are applied to the preconditioned residual, and both
    # sums that the next round needs are taken while its rows are written.
    r, u = F.col("r"), F.col("r") / F.col("degree")

    def pulled(rows: DataFrame) -> DataFrame:
        sent = steps.join(rows.select(F.col("id").alias("src"), u.alias("q")), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("weight") * F.col("q")).alias("pull")
        )
        return rows.join(sent, "id", "left").withColumn("w", r - F.coalesce("pull", F.lit(0.0))).drop("pull")

    sums = {"norm": F.sum(r * r), "along": F.sum(r * u), "curve": F.sum(F.col("w") * u)}
    zero = F.lit(0.0)
    rows = base.select("id", "degree", zero.alias("x"), F.col("b").alias("r"), zero.alias("p"), zero.alias("s"))
    n = rows.count()
    limit = 10 * n + 100 if limit is None else limit
    done, converged = 0, n == 0
    state = base.select("id", zero.alias("x"))
    if n:
        state, told = measured(pulled(rows), "flow", **sums)
        norm, step, last = told["norm"], 0.0, 0.0
        converged = norm == 0
    while not converged and done < limit:
        ratio = told["along"] / last if done else 0.0
        against = told["curve"] - (ratio * told["along"] / step if done else 0.0)
        if not against > 0:
            break
        step, last = told["along"] / against, told["along"]
        p, s = u + ratio * F.col("p"), F.col("w") + ratio * F.col("s")
        moved = state.select("id", "degree", "x", "r", p.alias("p"), s.alias("s")).select(
            "id", "degree", (F.col("x") + step * F.col("p")).alias("x"), (r - step * F.col("s")).alias("r"), "p", "s"
        )
        before, (state, told) = state, measured(pulled(moved), "flow", **sums)
        forget(before)
        done += 1
        converged = told["norm"] <= tolerance * tolerance * norm
    solved = staged(state.select("id", "x"), "flow")
    potentials = reach.join(solved, "id", "left").select(
        "id", F.when(F.col("reached"), F.coalesce("x", F.lit(0.0))).alias("potential"), "reached"
    )
    return PotentialFlow(potentials, done, converged)


def edge_flow(pairs: DataFrame, potentials: DataFrame) -> DataFrame:
    """``src, dst, flow`` for ``pairs(src, dst, weight)``; 0 where an end is unreached."""
    v: Column = F.col("weight") * (F.col("vs") - F.col("vd"))
    side = potentials.select("id", "potential")
    return (
        pairs.join(side.toDF("src", "vs"), "src").join(side.toDF("dst", "vd"), "dst")
        .select("src", "dst", F.when(F.col("vs").isNull() | F.col("vd").isNull(), F.lit(0.0)).otherwise(v).alias("flow"))
    )
