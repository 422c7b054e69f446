"""Cheapest and shortest routes by rounds of relaxation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..graph import AnyGraph, CostOf, Graph
from ..plans.rounds import Lying, RoundLimit, fine_parts, forget, measured, staged, unbound

#: Nodes whose steps are tried in one round; they are broadcast to where the steps lie.
FRONT = 400_000
#: Steps and labels lie in the same parts: one for so many edges, and no more than so many.
PART, PARTS = 200_000, 480
_SHARES = [k / 32 for k in range(1, 33)]
_SCHEMA = "id bigint, cost double, source bigint, level int, previous bigint"


def node_table(spark: SparkSession, nodes: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(x),) for x in sorted(set(nodes))], "id bigint")


def _present(graph: AnyGraph, nodes: list[int], role: str) -> DataFrame:
    wanted = node_table(graph.vertices.sparkSession, nodes)
    missing = wanted.join(graph.vertices, "id", "left_anti").take(1)
    if missing:
        raise ValueError(f"{role} {missing[0][0]} is not a node of the graph")
    return wanted


def _priced(graph: AnyGraph, cost: CostOf | None) -> DataFrame:
    """Steps with their cost; infinite ones are left out, negative and NaN ones raise."""
    w = F.col("weight") if cost is None else cost(F.col("src"), F.col("dst"), F.col("weight")).cast("double")
    told = F.concat_ws(" ", F.lit("the step"), "src", F.lit("to"), "dst", F.lit("has a cost that is not allowed"))
    price = F.when(w.isNull() | F.isnan(w) | (w < 0), F.raise_error(told).cast("double")).otherwise(w)
    return graph.steps().select("src", "dst", price.alias("price"))


def shortest_routes(
    graph: AnyGraph,
    sources: Iterable[int],
    cost: CostOf | None = None,
    targets: Iterable[int] = (),
    max_rounds: int | None = None,
) -> DataFrame:
    """``id, cost, source, previous`` for every node that is reached.

    Of equally cheap routes the one from the lower source wins, then the one by
    the lower previous node.  ``cost(src, dst, weight)`` is a column expression;
    infinite forbids a step.  With ``targets`` the result holds what is settled
    once all of them are, in the order of (cost, source, id); if one cannot be
    reached nothing is cut off.

    Steps lie dealt by where they lead, and labels in the same parts.  Each round the nodes
    that changed, the cheapest ``FRONT`` of them if they are more, are sent to all steps; what
    is cheaper than the label that lies there becomes the new one.  So nothing is shuffled
    from round to round, and most nodes are followed only when their label is settled.
    Costs above the dearest target found so far are not followed.  A run of
    steps that cost nothing is ordered by its length first, so that routes never
    close on themselves.
    """
    sources, targets = sorted(set(sources)), sorted(set(targets))
    if not sources:
        raise ValueError("at least one source is needed")
    start = _present(graph, sources, "source")
    goals = _present(graph, targets, "target") if targets else None
    with fine_parts(graph.vertices.sparkSession):
        lines = "edges" if isinstance(graph, Graph) else "arcs"
        kept, told = measured(getattr(graph, lines), lines, n=F.count(F.lit(1)))
        parts = min(PARTS, 1 + told["n"] // PART)
        priced = _priced(replace(graph, **{lines: kept}), cost).where("price < double('inf')")
        steps = staged(priced.repartition(parts, "dst"), "steps", Lying("dst", parts, "src"))
        forget(kept)
        labels, bound = _relaxed(start, steps, parts, targets, max_rounds)
        forget(steps)
    found = labels.select("id", "label.cost", "label.source", F.when(F.col("label.previous") >= 0, F.col("label.previous")).alias("previous"))
    if goals is not None and bound < float("inf"):
        last = found.join(goals, "id").agg(F.max(F.struct("cost", "source", "id"))).first()[0]
        key = F.struct("cost", "source", "id")
        found = found.where(key <= F.struct(F.lit(last["cost"]).alias("cost"), F.lit(last["source"]).cast("bigint").alias("source"), F.lit(last["id"]).cast("bigint").alias("id")))
    return found


def _front(labels: DataFrame, told: Row | None) -> tuple[Column, bool]:
    """Which changed nodes are followed now, and whether they are few enough to be broadcast."""
    if told is None or told["fresh"] <= FRONT:
        return F.col("fresh"), True
    # Of 32 shares the highest that fits, by the costs of the nodes.
    fits = max(1, int(len(_SHARES) * FRONT / told["fresh"]))
    near = F.col("fresh") & (F.col("label.cost") <= told["costs"][fits - 1])
    return near, labels.where(near).count() <= 2 * FRONT


def _relaxed(start: DataFrame, steps: DataFrame, parts: int, targets: list[int], max_rounds: int | None) -> tuple[DataFrame, float]:
    """Labels that no step makes cheaper, and the cost of the dearest target if all are reached."""
    lying = Lying("id", parts, "id")
    labels = staged(start.select(
        "id", F.struct(F.lit(0.0).alias("cost"), F.col("id").alias("source"), F.lit(0).alias("level"), F.lit(-1).cast("bigint").alias("previous")).alias("label"),
        F.lit(True).alias("fresh"),
    ).repartition(parts, "id"), "labels", lying)
    bound, rounds, told = float("inf"), 0, None
    while True:
        now, few = _front(labels, told)
        front = labels.where(now)
        # Parts are sorted by where steps begin, so most of each is skipped when the front lies close together.
        near = steps if told is None else steps.where(F.col("src").between(told["low"], told["high"]))
        free = F.col("price") == 0
        tried = (F.broadcast(front) if few else front).join(near, F.col("id") == F.col("src")).select(
            F.col("dst").alias("id"),
            F.struct(
                (F.col("label.cost") + F.col("price")).alias("cost"),
                F.col("label.source").alias("source"),
                F.when(free, F.col("label.level") + 1).otherwise(0).alias("level"),
                F.col("src").alias("previous"),
            ).alias("tried"),
        ).where(F.col("tried.cost") <= bound)
        known = labels.select("id", F.col("label").alias("known")).hint("shuffle_hash")
        cheaper = tried.join(known, "id", "left").where(F.col("known").isNull() | (F.col("tried") < F.col("known"))).groupBy("id").agg(F.min("tried").alias("tried"))
        left = labels.select("id", "label", (F.col("fresh") & ~now).alias("left"))
        merged = left.join(cheaper.hint("shuffle_hash"), "id", "full").select(
            "id", F.coalesce("tried", "label").alias("label"), (F.col("tried").isNotNull() | F.col("left")).alias("fresh")
        )
        goal = F.col("id").isin(targets) if targets else F.lit(False)
        before, (labels, told) = labels, measured(
            merged, "labels", lying, fresh=F.count_if("fresh"), held=F.count_if(goal), dearest=F.max(F.when(goal, F.col("label.cost"))),
            low=F.min(F.when(F.col("fresh"), F.col("id"))), high=F.max(F.when(F.col("fresh"), F.col("id"))),
            costs=F.percentile_approx(F.when(F.col("fresh"), F.col("label.cost")), _SHARES, 1000),
        )
        forget(before)
        rounds += 1
        if targets and told["held"] == len(targets):
            bound = told["dearest"]
        if not told["fresh"]:
            return unbound(labels), bound
        if max_rounds is not None and rounds >= max_rounds:
            raise RoundLimit(f"routes still changed after {rounds} rounds")


def breadth_first(graph: AnyGraph, sources: Iterable[int], max_rounds: int | None = None) -> DataFrame:
    """``id, steps, source, previous``: fewest steps, whatever the weights.

    At one a step a node's label changes in one round only, so each edge is
    followed once from either end.
    """
    found = shortest_routes(graph, sources, lambda src, dst, weight: F.lit(1.0), max_rounds=max_rounds)
    return found.select("id", F.col("cost").cast("bigint").alias("steps"), "source", "previous")


def rings(reached: DataFrame) -> DataFrame:
    """``steps, nodes``: how many nodes lie at each number of steps."""
    return reached.groupBy("steps").agg(F.count("*").alias("nodes"))


def routes_to(reached: DataFrame, ends: DataFrame) -> DataFrame:
    """``end, route``: nodes from the source to each of ``ends(id)``, empty if unreached."""
    links = reached.select(F.col("id").alias("at"), "previous")
    at = ends.select(F.col("id").alias("end")).distinct()
    now = staged(at.join(links, F.col("end") == F.col("at")).select("end", "at", "previous", F.lit(0).alias("back")), "trace")
    parts = [now]
    walked = 0
    while True:
        walked += 1
        step = now.where("previous is not null").select("end", F.col("previous").alias("at"))
        now = staged(step.join(links, "at").select("end", "at", "previous", F.lit(walked).alias("back")), "trace")
        if now.isEmpty():
            break
        parts.append(now)
        if len(parts) >= 16:
            parts = [staged(_all(parts), "trace")]
    order = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "at")))
    routes = _all(parts).groupBy("end").agg(F.transform(order, lambda x: x["at"]).alias("route"))
    return at.join(routes, "end", "left").select(
        "end", F.coalesce("route", F.expr("cast(array() AS array<bigint>)")).alias("route")
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def distance(ax: Column, ay: Column, bx: Column, by: Column, az: Column | None = None, bz: Column | None = None) -> Column:
    square = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    if az is not None and bz is not None:
        square = square + (az - bz) * (az - bz)
    return F.sqrt(square)


def goal_route(
    graph: AnyGraph, source: int, target: int, estimate: DataFrame, cost: CostOf | None = None, max_rounds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """A goal-directed search: the cheapest route and the nodes that were looked at.

    ``estimate(id, h)`` is a lower bound of the cost from a node to ``target``.
    Rounds relax as in ``shortest_routes``, but a label whose cost plus estimate
    exceeds the best cost known for the target is dropped before the join.
    Returns ``id, cost, source, previous`` of the route's nodes (none without a
    route), and ``id`` of the nodes whose steps were tried.
    """
    _present(graph, [source, target], "node")
    spark = graph.vertices.sparkSession
    bad = F.col("h").isNull() | F.isnan("h") | (F.col("h") < 0) | (F.col("h") == float("inf"))
    h = estimate.select("id", F.when(bad, F.raise_error(F.lit("an estimate is negative or not finite")).cast("double")).otherwise(F.col("h")).alias("h"))
    steps = staged(_priced(graph, cost).where("price < double('inf')").join(h.withColumnRenamed("id", "dst"), "dst"), "steps")
    labels = node_table(spark, [source]).select(
        "id", F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("level"), F.lit(-1).cast("bigint").alias("previous")).alias("label"),
        F.lit(0.0).alias("h"), F.lit(True).alias("fresh"),
    )
    bound, rounds = (0.0 if source == target else float("inf")), 0
    looked: list[DataFrame] = []
    while source != target:
        front = labels.where("fresh").where((F.col("label.cost") + F.col("h") <= bound) & (F.col("id") != target))
        looked.append(staged(front.select("id"), "looked"))
        if len(looked) >= 16:
            looked = [staged(_all(looked).distinct(), "looked")]
        tried = front.select("id", "label").join(steps, F.col("id") == F.col("src")).select(
            F.col("dst").alias("id"),
            F.struct(
                (F.col("label.cost") + F.col("price")).alias("cost"),
                F.when(F.col("price") == 0, F.col("label.level") + 1).otherwise(0).alias("level"),
                F.col("src").alias("previous"),
            ).alias("label"),
            "h",
            F.lit(None).cast("struct<cost: double, level: int, previous: bigint>").alias("old"),
        ).where(F.col("label.cost") + F.col("h") <= bound)
        merged = labels.select("id", "label", "h", F.col("label").alias("old")).union(tried).groupBy("id").agg(
            F.min("label").alias("label"), F.max("h").alias("h"), F.max("old").alias("old")
        ).select("id", "label", "h", (F.col("old").isNull() | (F.col("label") < F.col("old"))).alias("fresh"))
        before, (labels, told) = labels, measured(
            merged, "labels", fresh=F.count_if("fresh"), best=F.max(F.when(F.col("id") == target, F.col("label.cost")))
        )
        forget(before)
        rounds += 1
        if told["best"] is not None:
            bound = told["best"]
        if not told["fresh"]:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RoundLimit(f"the route still changed after {rounds} rounds")
    reached = labels.select(
        "id", "label.cost", F.lit(source).cast("bigint").alias("source"),
        F.when(F.col("label.previous") >= 0, F.col("label.previous")).alias("previous"),
    )
    route = routes_to(reached, node_table(spark, [target])).select(F.explode("route").alias("id"))
    seen = _all(looked).distinct() if looked else node_table(spark, [source])
    return reached.join(route, "id", "left_semi"), seen
