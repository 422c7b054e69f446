import math
from dataclasses import dataclass

import pytest
from plain import column, digraph, graph, table

from tidegraph.plans import methods
from tidegraph.plans.outcome import PathOutcome, short
from tidegraph.plans.query import PathQuery

#: A pentagon round a hub, node 5; spokes are shorter than two sides, and every weight is at least the way through space.
RING = [(i, (i + 1) % 5, 2.5) for i in range(5)] + [(i, 5, 2.0 + (i == 3)) for i in range(5)]
AT = [(i, 2 * math.cos(2 * math.pi * i / 5), 2 * math.sin(2 * math.pi * i / 5), 0) for i in range(5)] + [(5, 0, 0, 0)]


@pytest.fixture(scope="module")
def ring(spark):
    return graph(spark, 6, RING)


@pytest.fixture(scope="module")
def at(spark):
    return table(spark, [(r[0], *map(float, r[1:])) for r in AT], "id bigint, x double, y double, z double")


def test_dijkstra(ring):
    out = methods.solve(PathQuery.of(ring, [1], [4]), methods.DijkstraMethod())
    assert column(out.routes, "route", "end") == {4: [1, 5, 4]} and out.reached_count() == 1
    assert column(out.values, "value")[4] == 4.0
    assert out.report()[0] == "Dijkstra."


def test_breadth_first(ring):
    out = methods.solve(PathQuery.of(ring, [3]), methods.BreadthFirstMethod())
    assert column(out.groups, "group") == {3: 0, 2: 1, 4: 1, 5: 1, 0: 2, 1: 2}


def test_astar_and_metric(spark, ring, at):
    out = methods.solve(PathQuery.of(ring, [1], [4], at), methods.AStarMethod())
    assert column(out.values, "value") == {0: None, 1: 0.0, 2: None, 3: None, 4: 4.0, 5: 2.0}
    assert methods.choose_metric(PathQuery.of(ring, [1], [4], at))[0] is methods.EstimateMetric.THREE_DIMENSIONS
    cheap = graph(spark, 6, [(2, 5, 0.5), *[r for r in RING if r[:2] != (2, 5)]])
    metric, safe = methods.choose_metric(PathQuery.of(cheap, [1], [4], at))
    assert metric is methods.EstimateMetric.UNSAFE and math.isclose(safe, 0.25)
    assert methods.solve(PathQuery.of(cheap, [1], [4], at), methods.AStarMethod()).warnings
    with pytest.raises(ValueError):
        methods.solve(PathQuery.of(ring, [1], [4]), methods.AStarMethod())


def test_flow_on_directed(spark):
    d = digraph(spark, 4, [(0, 3, 4), (3, 0, 1), (3, 1, 2), (1, 2, 2), (2, 3, 1)])
    out = methods.solve(PathQuery.of(d, [0], [1]), methods.PotentialFlowMethod())
    flow = {(r["src"], r["dst"]): round(r["value"], 6) for r in out.connection_values.collect()}
    assert flow == {(0, 3): 1.0, (3, 0): -1.0, (3, 1): 0.75, (1, 2): -0.25, (2, 3): -0.25} and out.remarks


def test_whole_graph_methods(spark, ring):
    apart = PathQuery.of(graph(spark, 6, [(4, 2), (2, 0), (5, 3)]), [0], [3])
    pieces = methods.solve(apart, methods.ConnectedPiecesMethod())
    assert column(pieces.values, "value") == {0: 0.0, 2: 0.0, 4: 0.0, 1: 1.0, 3: 2.0, 5: 2.0}
    assert [r["id"] for r in pieces.marked.collect()] == [1] and "in 3 pieces" in pieces.details[0] and "2 pieces" in pieces.details[-1]
    cut = methods.solve(apart, methods.CutVerticesMethod())
    assert [r["id"] for r in cut.marked.collect()] == [2] and cut.groups.count() == 6
    busy = methods.solve(PathQuery.of(ring), methods.BetweennessMethod())
    assert busy.marked.first()["id"] == 5
    levels = methods.solve(PathQuery.of(digraph(spark, 6, [(0, 4), (4, 3), (3, 5), (5, 4), (1, 0), (2, 5)])), methods.DependencyLevelsMethod())
    assert column(levels.values, "value") == {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r["id"] for r in levels.marked.collect()} == {3, 4, 5}
    with pytest.raises(ValueError):
        methods.solve(PathQuery.of(ring), methods.DependencyLevelsMethod())


def test_auto(ring, at):
    def chosen(**ends):
        method, asked, why = methods.AutoMethod().choose(PathQuery.of(ring, **ends))
        assert why
        return method.name, asked.sources, asked.targets

    assert chosen() == ("Connected Pieces", (), ())
    assert chosen(targets=[2]) == ("Dijkstra", (2,), ())
    assert chosen(sources=[0], targets=[2]) == ("Dijkstra", (0,), (2,))
    assert chosen(sources=[0], targets=[2], positions=at) == ("A*", (0,), (2,))
    out = methods.solve(PathQuery.of(ring, [0]))
    assert out.rationale and "chosen because" in out.report()[0]


def test_check_and_values(ring):
    @dataclass(frozen=True)
    class Short(methods.GraphMethod):
        name = "Short"

        def run(self, query):
            return PathOutcome("Short", values=query.graph.vertices.limit(2).selectExpr("id", "1d as value"), values_name="Nothing")

    with pytest.raises(RuntimeError, match="2 values where there are 6"):
        methods.solve(PathQuery.of(ring), Short())
    assert methods.AStarMethod(0.5) == methods.AStarMethod(0.5) != methods.AStarMethod()
    assert str(methods.AStarMethod(0.5)) == "A*, estimate scale 0.5" and short(2.0) == "2"
    with pytest.raises(ValueError):
        PathQuery.of(ring, [7])
