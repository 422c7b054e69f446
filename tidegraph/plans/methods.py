"""Methods that answer a query; each is a value that can be compared and described."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..operators.centrality import MAXIMUM_SOURCES, betweenness, busiest
from ..operators.components import numbered_components
from ..operators.condensation import condensation
from ..operators.cuts import cut_structure
from ..operators.flow import edge_flow, potential_flow
from ..operators.routes import breadth_first, goal_route, node_table, routes_to, shortest_routes
from .outcome import PathOutcome, counted, short
from .query import PathQuery
from .rounds import staged


def _ranked(ids: DataFrame) -> DataFrame:
    """``rank, id`` by ascending id."""
    return dense_index(ids.select("id")).select(F.col("index").alias("rank"), "id")


def _values(query: PathQuery, reached: DataFrame, column: str) -> DataFrame:
    return query.graph.vertices.join(reached, "id", "left").select("id", F.col(column).cast("double").alias("value"))


def _span(query: PathQuery) -> str:
    to = counted(len(query.targets), "target") if query.targets else "every node"
    return f"from {counted(len(query.sources), 'source')} to {to}"


class GraphMethod(ABC):
    """A way to answer a query.  Subclass it as a frozen dataclass to add one."""

    name: str = "Method"

    @abstractmethod
    def run(self, query: PathQuery) -> PathOutcome: ...

    def describe(self) -> str:
        return self.name

    def __str__(self) -> str:
        return self.describe()

    def direction_ignored(self) -> str:
        return f"{self.name} is defined without direction, so the direction of arcs was ignored and the larger weight kept."

    def ends_ignored(self) -> str:
        return f"{self.name} reads the whole graph; sources and targets play no part."


@dataclass(frozen=True)
class DijkstraMethod(GraphMethod):
    name = "Dijkstra"

    def describe(self) -> str:
        return "Dijkstra, cheapest routes by weight"

    def run(self, query: PathQuery) -> PathOutcome:
        query.require_sources(self.name)
        tree = staged(shortest_routes(query.graph, query.sources, targets=query.targets), "routes")
        routes = staged(routes_to(tree, query.ends()), "traced")
        missed = routes.where(F.size("route") == 0).select(F.col("end").alias("id"))
        unreached = missed.count()
        ends = len(query.targets) or query.node_count()
        remarks = (f"{counted(unreached, 'node')} cannot be reached from a source.",) if unreached else ()
        return PathOutcome(
            self.name, routes=routes, values=_values(query, tree, "cost"), values_name="Cost",
            marked=_ranked(missed), marked_name="Unreached", remarks=remarks,
            details=(f"Cheapest routes {_span(query)}; {ends - unreached} of {ends} reached.",),
        )


@dataclass(frozen=True)
class BreadthFirstMethod(GraphMethod):
    name = "Breadth-First"

    def describe(self) -> str:
        return "Breadth-First, fewest steps"

    def run(self, query: PathQuery) -> PathOutcome:
        query.require_sources(self.name)
        tree = staged(breadth_first(query.graph, query.sources), "routes")
        routes = staged(routes_to(tree, query.ends()), "traced")
        missed = routes.where(F.size("route") == 0).select(F.col("end").alias("id"))
        far, reached = tree.agg(F.max("steps"), F.count("*")).first()
        stranded = query.node_count() - reached
        remarks = (f"{counted(stranded, 'node')} cannot be reached from a source.",) if stranded else ()
        return PathOutcome(
            self.name, routes=routes, values=_values(query, tree, "steps"), values_name="Steps",
            groups=tree.select(F.col("steps").alias("group"), "id"), groups_name="Ring",
            marked=_ranked(missed), marked_name="Unreached", remarks=remarks,
            details=(f"Fewest steps {_span(query)}, {counted(far, 'ring')} outwards.", "A step counts one, whatever it weighs."),
        )


class EstimateMetric(Enum):
    THREE_DIMENSIONS = "three dimensions"
    PLAN = "plan"
    UNSAFE = "unsafe"


def choose_metric(query: PathQuery, scale: float = 1.0) -> tuple[EstimateMetric, float]:
    """The distance that the weights vouch for at ``scale``, and the largest scale safe in plan.

    A scaled distance never overestimates if no connection weighs less than its
    scaled length; connections without length say nothing.
    """
    if not query.has_positions or scale == 0:
        return EstimateMetric.THREE_DIMENSIONS, math.inf
    least = []
    for plan in (False, True):
        rows = query.between(query.connections(), plan).where("apart > 0")
        low = rows.agg(F.min(F.col("weight") / F.col("apart"))).first()[0]
        least.append(math.inf if low is None else low)
    slack = 1 - 1e-9
    if least[0] >= scale * slack:
        return EstimateMetric.THREE_DIMENSIONS, least[1]
    return (EstimateMetric.PLAN if least[1] >= scale * slack else EstimateMetric.UNSAFE), least[1]


@dataclass(frozen=True)
class AStarMethod(GraphMethod):
    """Goal-directed: rounds of relaxation that drop what cannot beat the best route known."""

    estimate_scale: float = 1.0
    name = "A*"

    def describe(self) -> str:
        return f"A*, estimate scale {short(self.estimate_scale)}"

    def run(self, query: PathQuery) -> PathOutcome:
        if not (math.isfinite(self.estimate_scale) and self.estimate_scale >= 0):
            raise ValueError("the estimate scale must be finite and not negative")
        query.require_positions(self.name)
        query.require_one_to_one(self.name)
        source, target = query.sources[0], query.targets[0]
        metric, safe = choose_metric(query, self.estimate_scale)
        warnings = ()
        if metric is EstimateMetric.UNSAFE:
            warnings = (f"Some connections weigh less than the scaled distance, so the route may not be the cheapest; a scale of {short(max(safe, 0.0))} is safe.",)
        pairs = query.graph.vertices.select(F.col("id").alias("src"), F.lit(target).cast("bigint").alias("dst"))
        apart = query.between(pairs, plan=metric is not EstimateMetric.THREE_DIMENSIONS)
        estimate = apart.select(F.col("src").alias("id"), (F.col("apart") * self.estimate_scale).alias("h"))
        found, looked = goal_route(query.graph, source, target, estimate)
        found, looked = staged(found, "routes"), staged(looked, "looked")
        routes = staged(routes_to(found, node_table(query.graph.vertices.sparkSession, [target])), "traced")
        cost = found.where(F.col("id") == target).agg(F.max("cost")).first()[0]
        seen, n = looked.count(), query.node_count()
        say = f"No route from {source} to {target}" if cost is None else f"The route from {source} to {target} costs {short(cost)}"
        how = {
            EstimateMetric.THREE_DIMENSIONS: "Steered by distance in three dimensions.",
            EstimateMetric.PLAN: "Steered by distance in plan, which the weights vouch for.",
            EstimateMetric.UNSAFE: "Steered by distance in plan, which the weights do not vouch for.",
        }[metric]
        return PathOutcome(
            self.name, routes=routes, values=_values(query, found, "cost"), values_name="Cost",
            marked=_ranked(looked), marked_name="Explored", warnings=warnings,
            remarks=("No route reaches the target.",) if cost is None else (),
            details=(f"{say}; {seen} of {n} nodes were looked at.", how),
        )


@dataclass(frozen=True)
class PotentialFlowMethod(GraphMethod):
    injection: float = 1.0
    name = "Potential Flow"

    def describe(self) -> str:
        return f"Potential Flow, {short(self.injection)} entering per source"

    def run(self, query: PathQuery) -> PathOutcome:
        if not math.isfinite(self.injection):
            raise ValueError("what enters must be finite")
        query.require_targets(self.name, "a node where what enters can drain")
        graph, lost = query.undirected()
        spark = graph.vertices.sparkSession
        inlets = node_table(spark, query.sources) if query.sources else graph.vertices
        flow = potential_flow(graph, inlets.select("id", F.lit(float(self.injection)).alias("amount")), node_table(spark, query.targets))
        merged = graph.weight_of(query.connections())
        onto = merged.join(edge_flow(merged, flow.potentials), ["src", "dst"]).select("src", "dst", F.col("flow").alias("value"))
        dry = flow.potentials.where("not reached")
        n = dry.count()
        warnings = [f"{counted(n, 'node')} cannot drain to a target."] if n else []
        if not flow.converged:
            warnings.append(f"The solver stopped after {flow.iterations} rounds short of its tolerance; the flows are approximate.")
        where = f"at each of {counted(len(query.sources), 'source')}" if query.sources else "at every node"
        return PathOutcome(
            self.name, values=flow.potentials.select("id", F.col("potential").alias("value")), values_name="Potential",
            connection_values=onto, connection_values_name="Flow from the first node to the second, negative the other way",
            marked=_ranked(dry), marked_name="Unreached", warnings=tuple(warnings),
            remarks=(self.direction_ignored(),) if lost else (),
            details=(f"{short(self.injection)} enters {where} and drains at {counted(len(query.targets), 'target')}.",),
        )


@dataclass(frozen=True)
class BetweennessMethod(GraphMethod):
    maximum_sources: int = MAXIMUM_SOURCES
    top: int = 10
    name = "Betweenness"

    def describe(self) -> str:
        return f"Betweenness, exact up to {self.maximum_sources} nodes"

    def run(self, query: PathQuery) -> PathOutcome:
        if self.maximum_sources < 1:
            raise ValueError("at least one source is needed")
        graph, lost = query.undirected()
        scores = staged(betweenness(graph, self.maximum_sources), "scores")
        best = busiest(scores, self.top).collect()  # at most ``top`` rows
        spark = graph.vertices.sparkSession
        marked = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(best)], "rank bigint, id bigint")
        n = graph.node_count()
        remarks = [self.direction_ignored()] if lost else []
        if query.sources or query.targets:
            remarks.append(self.ends_ignored())
        if n > self.maximum_sources:
            remarks.append(f"Estimated from {self.maximum_sources} of {n} nodes.")
        return PathOutcome(
            self.name, values=scores.select("id", F.col("betweenness").alias("value")), values_name="Betweenness, 0 to 1",
            marked=marked, marked_name="Busiest first", remarks=tuple(remarks),
            details=("A node's value is the part of shortest routes between others that pass it.",),
        )


@dataclass(frozen=True)
class ConnectedPiecesMethod(GraphMethod):
    name = "Connected Pieces"

    def run(self, query: PathQuery) -> PathOutcome:
        graph, lost = query.undirected()
        pieces = staged(numbered_components(graph), "pieces")
        n = pieces.select("component").distinct().count()
        alone = pieces.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        details = ["The graph is one piece." if n == 1 else f"The graph is in {n} pieces; nothing passes between them."]
        if (k := alone.count()) > 0:
            details.append(f"{counted(k, 'node')} connected to nothing.")
        ends = sorted({*query.sources, *query.targets})
        if len(ends) > 1:
            held = pieces.join(node_table(graph.vertices.sparkSession, ends), "id").select("component").distinct().count()
            details.append("All sources and targets lie in one piece." if held == 1 else f"Sources and targets lie in {held} pieces.")
        return PathOutcome(
            self.name, values=pieces.select("id", F.col("component").cast("double").alias("value")),
            values_name="Piece, numbered by its lowest node",
            groups=pieces.select(F.col("component").alias("group"), "id"), groups_name="Piece",
            marked=_ranked(alone), marked_name="Isolated, connected to nothing",
            remarks=(self.direction_ignored(),) if lost else (), details=tuple(details),
        )


@dataclass(frozen=True)
class CutVerticesMethod(GraphMethod):
    name = "Cut Vertices"

    def describe(self) -> str:
        return "Cut Vertices and bridges"

    def run(self, query: PathQuery) -> PathOutcome:
        graph, lost = query.undirected()
        stranded, bridges = cut_structure(graph)
        stranded, bridges = staged(stranded, "stranded"), staged(bridges, "bridges")
        pairs = query.connections().withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
        onto = pairs.join(bridges.withColumn("hit", F.lit(1.0)), ["a", "b"], "left").select(
            "src", "dst", F.coalesce("hit", F.lit(0.0)).alias("value")
        )
        cut = stranded.where("stranded > 0")
        # Most stranding first: numbered by the negated count, then by id.
        order = dense_index(cut.select((-F.col("stranded")).alias("id")).distinct()).select((-F.col("id")).alias("stranded"), F.col("index").alias("rank"))
        remarks = [self.direction_ignored()] if lost else []
        if query.sources or query.targets:
            remarks.append(self.ends_ignored())
        n, m = cut.count(), bridges.count()
        return PathOutcome(
            self.name, values=stranded.select("id", F.col("stranded").cast("double").alias("value")),
            values_name="Stranded: how many nodes are cut off from the rest if this one goes",
            connection_values=onto, connection_values_name="Bridge, 1 where losing the connection splits the graph",
            groups=bridges.select(F.explode(F.array(
                F.struct(F.struct("a", "b").alias("group"), F.col("a").alias("id")), F.struct(F.struct("a", "b").alias("group"), F.col("b").alias("id"))
            )).alias("x")).select("x.*"),
            groups_name="Bridge",
            marked=cut.join(order, "stranded").select("rank", "id"), marked_name="Cut vertices, most stranding first",
            remarks=tuple(remarks),
            details=(f"{counted(n, 'node')} and {counted(m, 'connection')} hold the graph together alone.",),
        )


@dataclass(frozen=True)
class DependencyLevelsMethod(GraphMethod):
    name = "Dependency Levels"

    def run(self, query: PathQuery) -> PathOutcome:
        query.require_directed(self.name, "an arc says that its tail depends on its head")
        levels = staged(condensation(query.directed()), "levels")
        sizes = levels.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        looped = levels.join(sizes.select("component"), "component", "left_semi")
        top, k = levels.agg(F.max("height")).first()[0], sizes.count()
        remarks = [f"{counted(k, 'cycle')} folded into one level each."] if k else []
        if query.sources or query.targets:
            remarks.append(self.ends_ignored())
        return PathOutcome(
            self.name, values=levels.select("id", F.col("height").cast("double").alias("value")),
            values_name="Level, the longest chain of dependence below the node",
            groups=levels.select(F.col("height").alias("group"), "id"), groups_name="Level",
            marked=_ranked(looped), marked_name="In a cycle", remarks=tuple(remarks),
            details=(f"{counted(top + 1, 'level')}; what a node depends on lies lower.",),
        )


@dataclass(frozen=True)
class AutoMethod(GraphMethod):
    """Chooses by what the query gives: nothing, targets alone, one pair in space, or sources."""

    name = "Auto"

    def describe(self) -> str:
        return "Auto: routes when there are sources, pieces when there are none"

    def choose(self, query: PathQuery) -> tuple[GraphMethod, PathQuery, str]:
        if not query.sources and not query.targets:
            return ConnectedPiecesMethod(), query, "neither sources nor targets were given"
        if not query.sources:
            return DijkstraMethod(), query.with_ends(query.targets, ()), "only targets were given, and routes start from them"
        if len(query.sources) == len(query.targets) == 1 and query.has_positions:
            if choose_metric(query)[0] is not EstimateMetric.UNSAFE:
                return AStarMethod(), query, "one source, one target and positions that the weights vouch for were given"
        why = "sources and targets were given" if query.targets else "sources were given without targets"
        return DijkstraMethod(), query, why

    def run(self, query: PathQuery) -> PathOutcome:
        method, asked, why = self.choose(query)
        return replace(method.run(asked), rationale=why)


def solve(query: PathQuery, method: GraphMethod | None = None, check: bool = True) -> PathOutcome:
    """Runs ``method``, or the one that fits the query, and checks what it gives."""
    outcome = (method or AutoMethod()).run(query)
    if check:
        outcome.check(query.graph.vertices, query.connection_count())
    return outcome
