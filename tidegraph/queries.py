"""Every operator applied to networks over the tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import DiGraph, Duplicates, Graph
from .operators import centrality, components, condensation, cuts, features, flow, planar, routes, solid, weld
from .plans import methods
from .plans.query import PathQuery
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: How far points are looked at for lines of sight.
SIGHT = 1.5


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _first(spark: SparkSession, graph: Graph) -> int:
    return graph.edges.agg(F.min("a")).first()[0]


def _targets(graph: Graph) -> set[int]:
    """Three nodes to go to: the ends of the order of the parts, and the last supplier."""
    return set(graph.edges.agg(F.min("b"), F.max("b"), F.max("a")).first())


def _tree(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    graph = tables.supply(spark, folder)
    return routes.shortest_routes(graph, [_first(spark, graph)]).select(*columns)


def market(spark: SparkSession, folder: str) -> Graph:
    """Regions (0..), nations (from 5) and suppliers (from 30) as trees."""
    nation, supplier = tables.read(spark, folder, "nation"), tables.read(spark, folder, "supplier")
    pairs = nation.select(F.col("n_regionkey").cast("bigint").alias("a"), (F.col("n_nationkey") + 5).cast("bigint").alias("b")).union(
        supplier.select((F.col("s_nationkey") + 5).cast("bigint"), (F.col("s_suppkey") + 30).cast("bigint"))
    )
    regions = tables.read(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    return Graph.of(spark, regions.union(pairs.select("a")).union(pairs.select("b")), pairs)


def lattice(spark: SparkSession, folder: str) -> PathQuery:
    """Nations on a grid of five by five, three apart, linked to those beside them."""
    n = tables.read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    sides = n.select(
        F.col("id").alias("a"),
        F.explode(F.filter(F.array(F.when(F.col("id") % 5 < 4, F.col("id") + 1), F.when(F.col("id") < 20, F.col("id") + 5)), lambda x: x.isNotNull())).alias("b"),
    )
    graph = Graph.of(spark, n, sides.select("a", "b", (3.0 * (1 + (F.col("a") + F.col("b")) % 3)).alias("w")))
    at = n.select("id", (3.0 * (F.col("id") % 5)).alias("x"), (3.0 * F.floor(F.col("id") / 5)).alias("y"), F.lit(0.0).alias("z"))
    return PathQuery.of(graph, [0], [24], at)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """From every point to the one with the next id."""
    p = tables.places(spark, folder)
    a = p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    return a.join(b, "id")


def _cubes(spark: SparkSession, folder: str) -> DataFrame:
    """A cube on every nation's square, from z = 5 to z = 8, of twelve triangles."""
    n = tables.read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("obstacle_id"))
    x, y = 3.0 * (F.col("obstacle_id") % 5), 3.0 * F.floor(F.col("obstacle_id") / 5)
    corners = [F.array(x + dx, y + dy, F.lit(z)).cast("array<double>") for z in (5.0, 8.0) for dy in (0.0, 1.5) for dx in (0.0, 1.5)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = [f for a, b, c, d in quads for f in ((a, b, c), (a, c, d))]
    return n.select("obstacle_id", F.array(*corners).alias("vertices"), F.array(*[F.array(*map(F.lit, f)) for f in faces]).alias("faces"))


def _rhombi(spark: SparkSession, folder: str) -> DataFrame:
    """A square on its corner for every nation, in a grid of five by five."""
    n = tables.read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("obstacle_id"))
    x, y = 3.0 * (F.col("obstacle_id") % 5) + 1, 3.0 * F.floor(F.col("obstacle_id") / 5) + 1
    point = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return n.select("obstacle_id", F.array(point(1.125, 0.0), point(0.0, 1.125), point(-1.125, 0.0), point(0.0, -1.125)).alias("ring"))


def _octahedra(spark: SparkSession, folder: str) -> DataFrame:
    """Eight slanted triangles around the middle of every rhombus, at a height that differs from one to the next."""
    n = tables.read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("obstacle_id"))
    x, y = 3.0 * (F.col("obstacle_id") % 5) + 1, 3.0 * F.floor(F.col("obstacle_id") / 5) + 1
    z = 6 + F.col("obstacle_id") % 3
    tips = [(1.125, 0, 0), (0, 1.125, 0), (-1.125, 0, 0), (0, -1.125, 0), (0, 0, 1.125), (0, 0, -1.125)]
    corners = [F.array(x + dx, y + dy, z + dz).cast("array<double>") for dx, dy, dz in tips]
    faces = [(k, (k + 1) % 4, top) for k in range(4) for top in (4, 5)]
    return n.select("obstacle_id", F.array(*corners).alias("vertices"), F.array(*[F.array(*map(F.lit, f)) for f in faces]).alias("faces"))


def _network(spark: SparkSession, folder: str) -> weld.LineNetwork:
    """Segments whose ends lie a little beside the grid, so that ends that meet there are not equal."""
    aside = (F.col("line_id") % 3) / 64
    lines = _segments(spark, folder).withColumnRenamed("id", "line_id")
    return weld.weld(lines.withColumns({"ax": F.col("ax") + aside, "by": F.col("by") - aside}), 0.1)


def _sight(spark: SparkSession, folder: str) -> planar.VisibilityGraph:
    points = tables.places(spark, folder).select("id", "x", "y")
    return planar.visibility_graph(points, planar.PlanarObstacles.of(tables.boxes(spark, folder), 1e-6), reach=SIGHT)


def _pairs(graph: Graph) -> float:
    """Pairs of other nodes, of which betweenness is a part; times this it is a count."""
    n = graph.node_count()
    return (n - 1) * (n - 2) / 2


def _counted(s: SparkSession, d: str, sources: int) -> DataFrame:
    graph = tables.diary(s, d)
    found = centrality.betweenness(graph, sources)
    return found.select("id", F.round(F.col("betweenness") * _pairs(graph), 4).alias("paths"))


def _sampled(s: SparkSession, d: str) -> DataFrame:
    """What 64 sources alone owe to a node, before it is scaled up to all of them."""
    graph = tables.diary(s, d)
    n = graph.node_count()
    found = centrality.betweenness(graph, 64)
    return found.select("id", F.round(F.col("betweenness") * _pairs(graph) * 2 * min(n, 64) / n, 6).alias("owed"))


def _oldest(graph: Graph) -> int:
    return graph.vertices.agg(F.min("id")).first()[0]


def _diary_features(s: SparkSession, d: str) -> DataFrame:
    graph = tables.diary(s, d)
    names = [n for n in features.FEATURES if n not in ("Betweenness", "Closeness")]
    table = features.node_features(graph, [_oldest(graph)], readings=names).table
    return table.select("id", *[F.round(n, 6).alias(n.lower().replace(" ", "_")) for n in names])


def _potentials(s: SparkSession, d: str) -> DataFrame:
    graph = tables.trade(s, d)
    solved = flow.potential_flow(graph, graph.vertices.select("id", F.lit(1.0).alias("amount")), graph.vertices.where("id = 0"))
    return _round(solved.potentials.select("id", "potential"), "potential", digits=9)


def _acyclic(s: SparkSession, d: str) -> DataFrame:
    told = [(name, condensation.has_no_cycle(made(s, d))) for name, made in (("chains", tables.chains), ("returns", tables.returns))]
    return s.createDataFrame(told, "network string, acyclic boolean")


def _reached(s: SparkSession, d: str) -> DataFrame:
    query = _supply_query(s, d, targets=True)
    outcome = methods.solve(query, methods.DijkstraMethod())
    return s.createDataFrame([(outcome.reached_count(), len(outcome.report()) > 1)], "reached bigint, reported boolean")


def _tail(s: SparkSession, graph: DiGraph) -> int:
    return graph.arcs.agg(F.min("src")).first()[0]


def _unified(rule: Duplicates) -> Query:
    return lambda s, d: _round(tables.succession(s, d).undirected(rule).edges, "weight")


def _supply_query(s: SparkSession, d: str, targets: bool = False) -> PathQuery:
    graph = tables.supply(s, d)
    return PathQuery.of(graph, [_first(s, graph)], _targets(graph) if targets else ())


def _metric(s: SparkSession, d: str) -> DataFrame:
    metric, safe = methods.choose_metric(lattice(s, d))
    return s.createDataFrame([(metric.value, float(safe))], "metric string, safe_scale double")


def _drained(s: SparkSession, d: str) -> DataFrame:
    graph = market(s, d)
    roots = graph.vertices.where("id < 5")
    solved = flow.potential_flow(graph, graph.vertices.select("id", F.lit(1.0).alias("amount")), roots)
    pairs = graph.edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    return _round(flow.edge_flow(pairs, solved.potentials), "flow", digits=4)


def _conserved(s: SparkSession, d: str) -> DataFrame:
    graph = tables.trade(s, d)
    solved = flow.potential_flow(graph, graph.vertices.select(F.col("id").cast("bigint").alias("id"), F.lit(1.0).alias("amount")), graph.vertices.where("id = 0"))
    out = flow.edge_flow(graph.both_ways(), solved.potentials).groupBy(F.col("src").alias("id")).agg(F.sum("flow").alias("net"))
    return _round(out, "net", digits=4)


def _routes(s: SparkSession, d: str) -> DataFrame:
    graph = tables.supply(s, d)
    tree = routes.shortest_routes(graph, [_first(s, graph)])
    found = routes.routes_to(tree, routes.node_table(s, _targets(graph)))
    return found.select("end", F.array_join(F.col("route").cast("array<string>"), ",").alias("route"))


def _order(s: SparkSession, d: str) -> DataFrame:
    return condensation.condensation(tables.chains(s, d)).select("id", "height")


def _positions(s: SparkSession, d: str) -> DataFrame:
    """A place for every order such that what it depends on comes first."""
    return condensation.topological_places(condensation.condensation(tables.chains(s, d)))


def _pairs_of_nations(s: SparkSession, d: str) -> DataFrame:
    """Every nation with the next one and with itself, which has no edge."""
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"))
    return n.select("src", F.explode(F.array((F.col("src") + 1) % 25, F.col("src"))).alias("dst"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    graph, arcs = tables.supply(s, d), tables.succession(s, d)
    return s.createDataFrame([(graph.node_count(), graph.edge_count(), arcs.node_count(), arcs.arc_count())], "nodes bigint, edges bigint, tails_and_heads bigint, arcs bigint")


def _astar(s: SparkSession, d: str) -> DataFrame:
    outcome = methods.solve(lattice(s, d), methods.AStarMethod())
    return outcome.values.where("id = 24").select("id", "value")


def _auto(s: SparkSession, d: str) -> DataFrame:
    """Which method each kind of query gets, and what it says of the last node: see ``AutoMethod``."""
    pair = lattice(s, d)
    # The same places with weights that fall below the distances, which then vouch for nothing.
    cheap = PathQuery.of(pair.graph.reweight(F.col("weight") / 8), [0], [24], pair.positions)
    asked = {"targets alone": pair.with_ends((), (24,)), "a pair in space": pair, "a pair nothing vouches for": cheap, "sources alone": pair.with_ends((0,), ())}
    out = None
    for kind, query in asked.items():
        outcome = methods.solve(query)
        end = 0 if kind == "targets alone" else 24
        row = outcome.values.where(F.col("id") == end).select(F.lit(kind).alias("asked"), F.lit(outcome.method).alias("method"), "value")
        out = row if out is None else out.union(row)
    return out


def _betweenness_values(s: SparkSession, d: str) -> DataFrame:
    return _round(methods.solve(PathQuery.of(tables.diary(s, d)), methods.BetweennessMethod(10**9)).values, "value", digits=10)


def _trade_flow(s: SparkSession, d: str) -> DataFrame:
    found = methods.solve(PathQuery.of(tables.trade(s, d), targets=[0]), methods.PotentialFlowMethod()).connection_values
    return _round(found.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "value"), "value", digits=3)


def queries() -> dict[str, Query]:
    return {
        "graph_normalise": lambda s, d: tables.supply(s, d).edges,
        "degree": lambda s, d: _round(tables.supply(s, d).degree(), "degree", digits=3),
        "reweight": lambda s, d: _round(tables.trade(s, d).reweight(F.when(F.col("a") == 0, 0.0).otherwise(F.col("weight") / (F.col("a") + F.col("b")))).edges, "weight"),
        "to_directed": lambda s, d: tables.supply(s, d).directed().arcs,
        "to_undirected_min": _unified(Duplicates.KEEP_SMALLEST),
        "to_undirected_max": _unified(Duplicates.KEEP_LARGEST),
        "to_undirected_sum": _unified(Duplicates.SUM),
        "first_arc": lambda s, d: tables.succession(s, d).first_arcs(),
        "predecessors": lambda s, d: tables.succession(s, d).with_arc_ids().select("dst", "src", "weight", "arc_id"),
        "propagate": lambda s, d: _round(
            (g := tables.trade(s, d)).propagate(g.vertices.select("id", F.col("id").cast("double").alias("x")), ["x"], 100.0), "x"
        ).select(F.col("id").cast("bigint").alias("id"), "x"),
        "components": lambda s, d: components.numbered_components(tables.basket(s, d)),
        "piece_size": lambda s, d: components.piece_sizes(components.connected_components(tables.basket(s, d)), "lowest"),
        "bfs_steps": lambda s, d: routes.breadth_first(g := tables.supply(s, d), [_first(s, g)]),
        "bfs_rings": lambda s, d: routes.rings(routes.breadth_first(g := tables.supply(s, d), [_first(s, g)])),
        "dijkstra_cost": lambda s, d: _round(_tree(s, d, "id", "cost"), "cost", digits=2),
        "dijkstra_tree": lambda s, d: _tree(s, d, "id", "source", "previous"),
        "dijkstra_early_stop": lambda s, d: _round(
            routes.shortest_routes(g := tables.supply(s, d), [_first(s, g)], targets=_targets(g)).select("id", "cost"), "cost", digits=2
        ),
        "dijkstra_forbidden": lambda s, d: _round(
            routes.shortest_routes(g := tables.supply(s, d), [_first(s, g)], lambda a, b, w: F.when(b % 7 == 3, float("inf")).otherwise(w)).select("id", "cost"),
            "cost", digits=2,
        ),
        "routes_to_targets": _routes,
        "astar_cost": _astar,
        "choose_metric": _metric,
        "betweenness": lambda s, d: _round(centrality.betweenness(market(s, d), 10**9), "betweenness"),
        "betweenness_sampled": lambda s, d: _round(centrality.betweenness(market(s, d), 64), "betweenness"),
        "busiest_top10": lambda s, d: _round(centrality.busiest(centrality.betweenness(market(s, d), 10**9)), "betweenness"),
        "closeness": lambda s, d: _round(centrality.closeness(market(s, d), 10**9), "closeness"),
        "triangles": lambda s, d: _round(centrality.triangles(tables.succession(s, d).undirected(Duplicates.SUM)), "triangles"),
        "within_two_steps": lambda s, d: centrality.within_two_steps(tables.basket(s, d)),
        "bridges": lambda s, d: cuts.cut_structure(market(s, d))[1],
        "stranded": lambda s, d: cuts.cut_structure(market(s, d))[0],
        "articulation_points": lambda s, d: cuts.articulation_points(cuts.cut_structure(market(s, d))[0]),
        "bridges_diary": lambda s, d: cuts.cut_structure(tables.diary(s, d))[1],
        "stranded_diary": lambda s, d: cuts.cut_structure(tables.diary(s, d))[0],
        "betweenness_diary": lambda s, d: _counted(s, d, 10**9),
        "betweenness_diary_sampled": _sampled,
        "closeness_diary": lambda s, d: _round(centrality.closeness(tables.diary(s, d), 10**9), "closeness", digits=10),
        "node_features_diary": _diary_features,
        "flow_potentials": _potentials,
        "scc": lambda s, d: condensation.strong_components(tables.returns(s, d)),
        "is_acyclic": _acyclic,
        "successors": lambda s, d: (g := tables.succession(s, d)).successors(_tail(s, g)),
        "arc_weight": lambda s, d: tables.succession(s, d).weight(7),
        "dijkstra_directed": lambda s, d: routes.shortest_routes(g := tables.succession(s, d), [_tail(s, g)]).select("id", "cost"),
        "bfs_directed": lambda s, d: routes.breadth_first(g := tables.succession(s, d), [_tail(s, g)]).select("id", "steps"),
        "reached_count": _reached,
        "corners": lambda s, d: planar.PlanarObstacles.of(tables.boxes(s, d), 1e-6).corners().select("obstacle_id", "x", "y"),
        "levels": _order,
        "topological_order": _positions,
        "reached_from": lambda s, d: components.reached_from(g := tables.basket(s, d), g.edges.agg(F.min("a").alias("id"))),
        "neighbours": lambda s, d: (g := tables.supply(s, d)).neighbours(_first(s, g)),
        "weight_lookup": lambda s, d: tables.trade(s, d).weight_of(_pairs_of_nations(s, d)),
        "counts": _counts,
        "flow_edges": _drained,
        "flow_conservation": _conserved,
        "planar_contains": lambda s, d: planar.PlanarObstacles.of(tables.boxes(s, d), 1e-6).contains(tables.places(s, d)),
        "planar_blocks": lambda s, d: planar.PlanarObstacles.of(tables.boxes(s, d), 1e-6).blocks(_segments(s, d)),
        "visibility_edges": lambda s, d: _round(_sight(s, d).graph.edges, "weight"),
        "planar_contains_slanted": lambda s, d: planar.PlanarObstacles.of(_rhombi(s, d), 1e-6).contains(tables.places(s, d)),
        "planar_blocks_slanted": lambda s, d: planar.PlanarObstacles.of(_rhombi(s, d), 1e-6).blocks(_segments(s, d)),
        "solid_contains_slanted": lambda s, d: solid.SolidObstacles.of(_octahedra(s, d), 1e-6).contains(tables.places(s, d)),
        "solid_blocks_slanted": lambda s, d: solid.SolidObstacles.of(_octahedra(s, d), 1e-6).blocks(
            _segments(s, d).withColumnsRenamed({f"{k}{c}": f"{n}{c}" for k, n in zip("ab", "pq") for c in "xyz"})
        ),
        "solid_contains": lambda s, d: solid.SolidObstacles.of(_cubes(s, d), 1e-6).contains(tables.places(s, d)),
        "solid_blocks": lambda s, d: solid.SolidObstacles.of(_cubes(s, d), 1e-6).blocks(
            _segments(s, d).toDF("id", "px", "py", "pz", "qx", "qy", "qz")
        ),
        "weld_nodes": lambda s, d: _network(s, d).nodes,
        "weld_graph": lambda s, d: _round(_network(s, d).graph().edges, "weight"),
        "node_features": lambda s, d: features.node_features(market(s, d), [0]).table.select(
            "id", *[F.round(n, 6).alias(n.lower().replace(" ", "_")) for n in features.FEATURES]
        ),
        "auto_method": lambda s, d: methods.solve(PathQuery.of(tables.basket(s, d))).values,
        "method_dijkstra": lambda s, d: _round(methods.solve(_supply_query(s, d, targets=True), methods.DijkstraMethod()).values, "value", digits=2),
        "method_breadth_first": lambda s, d: methods.solve(_supply_query(s, d), methods.BreadthFirstMethod()).groups,
        "method_pieces": lambda s, d: methods.solve(PathQuery.of(market(s, d)), methods.ConnectedPiecesMethod()).groups,
        "method_cut_vertices": lambda s, d: methods.solve(PathQuery.of(market(s, d)), methods.CutVerticesMethod()).connection_values,
        "method_levels": lambda s, d: methods.solve(PathQuery.of(tables.returns(s, d)), methods.DependencyLevelsMethod()).marked.select("id"),
        "method_potential_flow": lambda s, d: _round(methods.solve(PathQuery.of(market(s, d), targets=range(5)), methods.PotentialFlowMethod()).connection_values, "value", digits=4),
        "method_pieces_diary": lambda s, d: methods.solve(PathQuery.of(tables.diary(s, d)), methods.ConnectedPiecesMethod()).groups,
        "method_cut_vertices_diary": lambda s, d: methods.solve(PathQuery.of(tables.diary(s, d)), methods.CutVerticesMethod()).connection_values,
        "method_betweenness_diary": _betweenness_values,
        "method_potential_flow_trade": _trade_flow,
        "auto_choices": _auto,
        "method_betweenness": lambda s, d: methods.solve(PathQuery.of(market(s, d)), methods.BetweennessMethod(10**9)).marked,
    }


# --- the same in DuckDB SQL -----------------------------------------------------

_BASKET = "e AS (SELECT DISTINCT least(2*l_orderkey, 2*l_partkey+1) AS a, greatest(2*l_orderkey, 2*l_partkey+1) AS b, 1.0::DOUBLE AS weight FROM lineitem)"
_SUPPLY = "e AS (SELECT least(2*l_suppkey, 2*l_partkey+1) AS a, greatest(2*l_suppkey, 2*l_partkey+1) AS b, max(l_extendedprice)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"
_BOTH = "s AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e)"
_NODES = "v AS (SELECT DISTINCT a AS id FROM s)"
_SUCC = """raw AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER o AS dst, l_quantity::DOUBLE AS weight FROM lineitem
  WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)
), arcs AS (SELECT src, dst, sum(weight) AS weight FROM raw WHERE src <> dst GROUP BY 1, 2),
ends AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs)"""
_TRADE = """e AS (
  SELECT least(s_nationkey, c_nationkey)::BIGINT AS a, greatest(s_nationkey, c_nationkey)::BIGINT AS b, sum(l_quantity)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
_LABELS = "r(n, m) USING KEY (n) AS (SELECT id, id FROM v UNION SELECT s.b, min(r.m) FROM r JOIN s ON r.n = s.a LEFT JOIN recurring.r x ON x.n = s.b WHERE x.n IS NULL OR r.m < x.m GROUP BY s.b)"


def _cost(weight: str, rule: str = "true", source: str = "(SELECT min(a) FROM e)") -> str:
    return f"""r(n, c) USING KEY (n) AS (
  SELECT {source}, 0::DOUBLE UNION
  SELECT s.b, min(r.c + {weight}) FROM r JOIN s ON r.n = s.a LEFT JOIN recurring.r x ON x.n = s.b
  WHERE ({rule}) AND (x.n IS NULL OR r.c + {weight} < x.c) GROUP BY s.b)"""


_GOALS = "goal AS (SELECT min(b) AS id FROM e UNION SELECT max(b) FROM e UNION SELECT max(a) FROM e)"
_DIJKSTRA = f"WITH RECURSIVE {_SUPPLY}, {_BOTH}, {_GOALS}, {_cost('s.weight')}"
#: Where a search that stops at its goals stops, if it reaches them all.
_LAST = "last AS (SELECT c, n FROM r WHERE n IN (SELECT id FROM goal) ORDER BY c DESC, n DESC LIMIT 1)"
_SETTLED = "((SELECT count(*) FROM r WHERE n IN (SELECT id FROM goal)) < (SELECT count(*) FROM goal) OR r.c < last.c OR (r.c = last.c AND r.n <= last.n))"
_STEPS = f"WITH RECURSIVE {_SUPPLY}, {_BOTH}, {_cost('1.0::DOUBLE')}"
_PREVIOUS = "p AS (SELECT r.n AS id, min(q.n) AS previous FROM r LEFT JOIN (s JOIN r q ON q.n = s.a) ON s.b = r.n AND q.c + {w} = r.c AND r.c > 0 GROUP BY r.n)"
#: Trees of regions, nations and suppliers: node, parent, root, depth, size of the subtree and of the piece.
_MARKET = """t AS (
  SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS up, r_regionkey::BIGINT AS root, 0 AS depth FROM region
  UNION ALL SELECT (n_nationkey + 5)::BIGINT, n_regionkey::BIGINT, n_regionkey::BIGINT, 1 FROM nation
  UNION ALL SELECT (s_suppkey + 30)::BIGINT, (s_nationkey + 5)::BIGINT, n_regionkey::BIGINT, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
), kids AS (SELECT up, count(*) AS k FROM t WHERE depth = 2 GROUP BY up),
piece AS (SELECT root, count(*) AS whole FROM t GROUP BY root),
z AS (SELECT t.*, whole, CASE depth WHEN 0 THEN whole WHEN 1 THEN 1 + coalesce(k, 0) ELSE 1 END AS size
      FROM t JOIN piece USING (root) LEFT JOIN kids ON kids.up = t.id),
branch AS (SELECT id, whole - size AS part FROM z WHERE whole > size UNION ALL SELECT up, size FROM z WHERE up IS NOT NULL),
cuts AS (SELECT id, sum(part) AS total, max(part) AS largest, sum(part * part) AS squares, count(*) AS links FROM branch GROUP BY id),
m AS (SELECT z.*, coalesce(total, 0) AS total, coalesce(largest, 0) AS largest, coalesce(squares, 0) AS squares, coalesce(links, 0) AS links,
             (SELECT count(*) FROM t) AS n FROM z LEFT JOIN cuts USING (id)),
score AS (SELECT *, round((total * total - squares) / 2.0 / ((n - 1.0) * (n - 2.0) / 2.0), 6)::DOUBLE AS betweenness FROM m)"""
_APART = """, apart AS (
  SELECT p.id, q.id AS other, CASE WHEN p.id = q.up OR q.id = p.up THEN 1 WHEN p.up = q.up THEN 2
    WHEN p.depth = 0 THEN q.depth WHEN q.depth = 0 THEN p.depth ELSE p.depth + q.depth END AS far
  FROM z p JOIN z q ON p.root = q.root AND p.id <> q.id),
near AS (SELECT id, count(*) AS reached, sum(far) AS total, count(*) FILTER (WHERE far <= 2) AS two FROM apart GROUP BY id)"""
_CLOSENESS = "coalesce(round(reached::DOUBLE / (n - 1) * (reached::DOUBLE / near.total), 6), 0.0)"
_PLACES = """p AS (SELECT vec_id::BIGINT AS id, round(embedding[1]::DOUBLE * 80) / 4 + 7 AS x, round(embedding[2]::DOUBLE * 80) / 4 + 7 AS y,
  round(embedding[3]::DOUBLE * 80) / 4 + 7 AS z FROM embeddings),
box AS (SELECT n_nationkey, 3.0 * (n_nationkey % 5) AS x0, 3.0 * (n_nationkey // 5) AS y0, 5.0 AS z0, 3.0 * (n_nationkey % 5) + 1.5 AS x1, 3.0 * (n_nationkey // 5) + 1.5 AS y1, 8.0 AS z1 FROM nation)"""


def _through(axes: str) -> str:
    """Whether the segment a-e passes through the inside of a box: clipped to a stretch, with no axis level outside."""
    low = [f"CASE WHEN e{c} = a{c} THEN 0 ELSE least(({c}0 - a{c}) / (e{c} - a{c}), ({c}1 - a{c}) / (e{c} - a{c})) END" for c in axes]
    high = [f"CASE WHEN e{c} = a{c} THEN 1 ELSE greatest(({c}0 - a{c}) / (e{c} - a{c}), ({c}1 - a{c}) / (e{c} - a{c})) END" for c in axes]
    level = " AND ".join(f"(e{c} <> a{c} OR (a{c} > {c}0 AND a{c} < {c}1))" for c in axes)
    return f"({level} AND least(1, {', '.join(high)}) - greatest(0, {', '.join(low)}) > 1e-9)"


def _beside(axes: str) -> str:
    """The least sum of a segment's distances to a middle along the axes: at an end, or where one of them is none."""
    at = ["0", "1", *[f"CASE WHEN e{c} <> a{c} THEN greatest(0, least(1, (m{c} - a{c}) / (e{c} - a{c}))) ELSE 0 END" for c in axes]]
    return f"least({', '.join(' + '.join(f'abs(a{c} + {t} * (e{c} - a{c}) - m{c})' for c in axes) for t in at)})"


_MIDDLES = """mid AS (SELECT 3.0 * (n_nationkey % 5) + 1 AS mx, 3.0 * (n_nationkey // 5) + 1 AS my, 6.0 + n_nationkey % 3 AS mz FROM nation)"""

_DIARY = """o AS (
  SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER own - 1 AS i, lag(o_orderkey) OVER own AS p, lag(o_orderkey) OVER alike AS q, lead(o_orderkey) OVER own AS f
  FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), alike AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)
), e AS (SELECT DISTINCT least(id, x) AS a, greatest(id, x) AS b, 1.0::DOUBLE AS weight FROM (SELECT id, p AS x FROM o UNION ALL SELECT id, q FROM o) WHERE x IS NOT NULL),
chord AS (SELECT o.c, w.i AS lo, o.i AS hi FROM o JOIN o w ON w.id = o.q WHERE o.i - w.i > 1),
lost AS (SELECT id, CASE WHEN EXISTS (SELECT 1 FROM chord WHERE chord.c = o.c AND lo < i AND hi > i) THEN 0 ELSE least(i, count(*) OVER (PARTITION BY c) - 1 - i) END AS stranded FROM o)"""
#: Steps between all orders of a customer, and how many shortest ways there are.
_WAYS = """far(z, n, d) USING KEY (z, n) AS (
  SELECT id, id, 0 FROM o UNION
  SELECT far.z, s.b, min(far.d + 1) FROM far JOIN s ON s.a = far.n LEFT JOIN recurring.far x ON x.z = far.z AND x.n = s.b
  WHERE x.n IS NULL OR far.d + 1 < x.d GROUP BY far.z, s.b
), ways(z, n, d, k) AS (
  SELECT id, id, 0, 1.0::DOUBLE FROM o UNION ALL
  SELECT w.z, s.b, w.d + 1, sum(w.k) FROM ways w JOIN s ON s.a = w.n JOIN far ON far.z = w.z AND far.n = s.b AND far.d = w.d + 1 GROUP BY w.z, s.b, w.d
), passed AS (
  SELECT x.z, x.n AS id, sum(x.k * y.k / t.k) AS owed FROM ways x JOIN ways y ON y.z = x.n JOIN ways t ON t.z = x.z AND t.n = y.n
  WHERE x.z <> x.n AND y.n <> x.n AND x.z <> y.n AND x.d + y.d = t.d GROUP BY x.z, x.n)"""
_RETURNS = """o AS (
  SELECT o_orderkey AS id, o_orderpriority AS r, o_custkey AS c, row_number() OVER own AS i, lead(o_orderkey) OVER own AS next
  FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), b AS (SELECT id, next, i, lag(id) OVER alike AS back, lag(i) OVER alike AS was FROM o WINDOW alike AS (PARTITION BY c, r ORDER BY i)),
arcs AS (SELECT id AS src, next AS dst FROM b WHERE next IS NOT NULL UNION SELECT id, back FROM b WHERE i - was = 3)"""
_SEGMENTS = "g AS (SELECT p.id, p.x AS ax, p.y AS ay, p.z AS az, q.x AS ex, q.y AS ey, q.z AS ez FROM p JOIN p q ON q.id = p.id + 1)"
#: Ends lie at most 2/64 beside a quarter grid, so those of one grid point join the first of them.
_WELDED = """ends AS (SELECT 2 * id AS k, ax AS u, ay AS v, az AS w, ax + (id % 3) / 64.0 AS x, ay AS y, az AS z FROM g
  UNION ALL SELECT 2 * id + 1, ex, ey, ez, ex, ey - (id % 3) / 64.0, ez FROM g),
made AS (SELECT u, v, w, min(k) AS k FROM ends GROUP BY u, v, w),
node AS (SELECT row_number() OVER (ORDER BY k) - 1 AS id, ends.x::DOUBLE AS x, ends.y::DOUBLE AS y, ends.z AS z, made.u, made.v, made.w FROM made JOIN ends USING (k))"""
_LATTICE = """e AS (
  SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT + d AS b, 3.0 * (1 + (2 * n_nationkey + d) % 3) AS weight
  FROM nation, (VALUES (1), (5)) AS steps(d) WHERE (d = 1 AND n_nationkey % 5 < 4) OR (d = 5 AND n_nationkey < 20))"""


def oracle_sql() -> dict[str, str]:
    components_sql = f"WITH RECURSIVE {_BASKET}, {_BOTH}, {_NODES}, {_LABELS} SELECT n AS id, dense_rank() OVER (ORDER BY m) - 1 AS "
    tree = f"{_DIJKSTRA}, {_PREVIOUS.format(w='s.weight')}"
    folded = "WITH {succ} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round({agg}(weight), 6) AS weight FROM arcs GROUP BY 1, 2 ORDER BY 1, 2"
    heights = "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS height FROM orders"
    closure = f"""WITH RECURSIVE {_RETURNS}, r AS (SELECT src, dst FROM arcs UNION SELECT r.src, arcs.dst FROM r JOIN arcs ON r.dst = arcs.src),
      mutual AS (SELECT x.src AS id, x.dst AS other FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src)"""
    drained = f"WITH {_MARKET} SELECT {{src}}, {{dst}}, {{sign}}round(size, 4)::DOUBLE AS {{name}} FROM z WHERE up IS NOT NULL"
    return {
        "graph_normalise": f"WITH {_SUPPLY} SELECT * FROM e",
        "degree": f"WITH {_SUPPLY}, {_BOTH} SELECT a AS id, round(sum(weight), 3) AS degree FROM s GROUP BY a",
        "reweight": f"WITH {_TRADE} SELECT a, b, round(weight / (a + b), 6) AS weight FROM e WHERE a > 0",
        "to_directed": f"WITH {_SUPPLY}, {_BOTH} SELECT a AS src, b AS dst, weight FROM s",
        "to_undirected_min": folded.format(succ=_SUCC, agg="min"),
        "to_undirected_max": folded.format(succ=_SUCC, agg="max"),
        "to_undirected_sum": folded.format(succ=_SUCC, agg="sum"),
        "first_arc": f"WITH {_SUCC}, k AS (SELECT id, count(src) AS n FROM ends LEFT JOIN arcs ON src = id GROUP BY id) SELECT id, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_arc FROM k",
        "predecessors": f"WITH {_SUCC} SELECT dst, src, weight, row_number() OVER (ORDER BY src, dst) - 1 AS arc_id FROM arcs",
        "propagate": f"""WITH {_TRADE}, {_BOTH}, d AS (SELECT a AS id, 1 / sqrt(sum(weight) + 100.0) AS k FROM s GROUP BY a)
          SELECT i.id, round(100.0 * i.k * i.k * i.id + sum(s.weight * i.k * j.k * j.id), 6) AS x
          FROM d i JOIN s ON s.a = i.id JOIN d j ON j.id = s.b GROUP BY i.id, i.k""",
        "components": components_sql + "component FROM r",
        "piece_size": f"WITH RECURSIVE {_BASKET}, {_BOTH}, {_NODES}, {_LABELS} SELECT n AS id, count(*) OVER (PARTITION BY m) AS piece_size FROM r",
        "bfs_steps": f"{_STEPS}, {_PREVIOUS.format(w='1')} SELECT r.n AS id, c::BIGINT AS steps, (SELECT min(a) FROM e) AS source, previous FROM r JOIN p ON p.id = r.n",
        "bfs_rings": f"{_STEPS} SELECT c::BIGINT AS steps, count(*) AS nodes FROM r GROUP BY c",
        "dijkstra_cost": f"{_DIJKSTRA} SELECT n AS id, round(c, 2) AS cost FROM r",
        "dijkstra_tree": f"{tree} SELECT id, (SELECT min(a) FROM e) AS source, previous FROM p",
        "dijkstra_early_stop": f"{_DIJKSTRA}, {_LAST} SELECT r.n AS id, round(r.c, 2) AS cost FROM r, last WHERE {_SETTLED}",
        "dijkstra_forbidden": f"WITH RECURSIVE {_SUPPLY}, {_BOTH}, {_cost('s.weight', 's.b % 7 <> 3')} SELECT n AS id, round(c, 2) AS cost FROM r",
        "routes_to_targets": f"""{tree}, w AS (
            SELECT id AS last, id AS at, id::VARCHAR AS route FROM p WHERE id IN (SELECT id FROM goal)
            UNION ALL SELECT w.last, q.previous, q.previous || ',' || w.route FROM w JOIN p q ON q.id = w.at WHERE q.previous IS NOT NULL)
          SELECT goal.id AS "end", coalesce(route, '') AS route FROM goal
          LEFT JOIN (SELECT last, route FROM w JOIN p ON p.id = w.at WHERE previous IS NULL) f ON f.last = goal.id""",
        "astar_cost": f"WITH RECURSIVE {_LATTICE}, {_BOTH}, {_cost('s.weight::DOUBLE')} SELECT n AS id, c AS value FROM r WHERE n = 24",
        "choose_metric": f"WITH {_LATTICE} SELECT CASE WHEN min(weight / 3.0) >= 1 - 1e-9 THEN 'three dimensions' ELSE 'unsafe' END AS metric, min(weight / 3.0)::DOUBLE AS safe_scale FROM e",
        "betweenness": f"WITH {_MARKET} SELECT id, betweenness FROM score",
        "busiest_top10": f"WITH {_MARKET} SELECT id, betweenness FROM score WHERE betweenness > 0 ORDER BY (total * total - squares) DESC, id LIMIT 10",
        "closeness": f"WITH {_MARKET}{_APART} SELECT m.id, {_CLOSENESS} AS closeness FROM m LEFT JOIN near USING (id)",
        "triangles": f"""WITH {_SUCC}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 1 AS weight FROM arcs), {_BOTH},
          d AS (SELECT a AS id, count(*) AS k FROM s GROUP BY a),
          c AS (SELECT x.a AS id, count(*) AS n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN s w ON w.a = x.b AND w.b = y.b GROUP BY x.a)
          SELECT id, CASE WHEN k >= 2 THEN round(2.0 * coalesce(n, 0) / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS triangles FROM d LEFT JOIN c USING (id)""",
        "within_two_steps": f"WITH {_BASKET}, {_BOTH}, f AS (SELECT a, b FROM s UNION SELECT x.a, y.b FROM s x JOIN s y ON x.b = y.a) SELECT a AS id, count(*) AS within_two FROM f WHERE a <> b GROUP BY a",
        "bridges": f"WITH {_MARKET} SELECT up AS a, id AS b FROM z WHERE up IS NOT NULL",
        "stranded": f"WITH {_MARKET} SELECT id, (total - largest)::BIGINT AS stranded FROM m",
        "articulation_points": f"WITH {_MARKET} SELECT id FROM m WHERE total > largest",
        "scc": f"{closure} SELECT o.id, least(o.id, coalesce(min(other), o.id)) AS lowest FROM o LEFT JOIN mutual ON mutual.id = o.id GROUP BY o.id",
        "bridges_diary": f"WITH {_DIARY} SELECT least(id, p) AS a, greatest(id, p) AS b FROM o WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chord WHERE chord.c = o.c AND lo < i AND hi >= i)",
        "stranded_diary": f"WITH {_DIARY} SELECT id, stranded::BIGINT AS stranded FROM lost",
        "betweenness_diary": f"WITH RECURSIVE {_DIARY}, {_BOTH}, {_WAYS} SELECT o.id, round(coalesce(sum(owed), 0) / 2, 4) AS paths FROM o LEFT JOIN passed USING (id) GROUP BY o.id",
        "closeness_diary": f"WITH RECURSIVE {_DIARY}, {_BOTH}, {_WAYS}, t AS (SELECT n AS id, count(*) AS k, sum(d) AS d FROM far WHERE z <> n GROUP BY n) SELECT o.id, coalesce(round(k / ((SELECT count(*) FROM o) - 1.0) * (k::DOUBLE / t.d), 10), 0.0) AS closeness FROM o LEFT JOIN t USING (id)",
        "node_features_diary": f"""WITH RECURSIVE {_DIARY}, {_BOTH}, {_WAYS}, k AS (SELECT a AS id, count(*) AS k FROM s GROUP BY a),
          tri AS (SELECT x.a AS id, count(*) AS n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN s w ON w.a = x.b AND w.b = y.b GROUP BY x.a),
          near AS (SELECT z AS id, count(*) FILTER (WHERE d BETWEEN 1 AND 2) AS two, count(*) AS whole FROM far GROUP BY z),
          origin AS (SELECT n AS id, d FROM far WHERE z = (SELECT min(id) FROM o))
          SELECT o.id, coalesce(k, 0)::DOUBLE AS connections, coalesce(k, 0)::DOUBLE AS strength, CASE WHEN k >= 2 THEN round(2.0 * coalesce(tri.n, 0) / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS triangles,
            two::DOUBLE AS within_two_steps, stranded::DOUBLE AS stranded, whole::DOUBLE AS piece_size, coalesce(origin.d, -1)::DOUBLE AS steps_to_source, coalesce(origin.d, -1)::DOUBLE AS cost_to_source
          FROM o JOIN lost USING (id) JOIN near USING (id) LEFT JOIN k USING (id) LEFT JOIN tri USING (id) LEFT JOIN origin USING (id)""",
        "flow_potentials": f"""WITH RECURSIVE {_TRADE}, {_BOTH}, w AS (SELECT a AS id, sum(weight) AS total FROM s GROUP BY a),
          x(k, id, p) AS (SELECT 0, id, 0.0::DOUBLE FROM w UNION ALL
            SELECT x.k + 1, w.id, CASE WHEN w.id = 0 THEN 0.0 ELSE (1 + sum(s.weight * x.p)) / w.total END FROM x JOIN s ON s.b = x.id JOIN w ON w.id = s.a WHERE x.k < 1000 GROUP BY x.k, w.id, w.total)
          SELECT id, round(p, 9) AS potential FROM x WHERE k = 1000""",
        "is_acyclic": f"{closure} SELECT 'chains' AS network, true AS acyclic UNION ALL SELECT 'returns', NOT EXISTS (SELECT 1 FROM mutual WHERE id <> other)",
        "successors": f"WITH {_SUCC} SELECT dst, weight FROM arcs WHERE src = (SELECT min(src) FROM arcs)",
        "arc_weight": f"WITH {_SUCC} SELECT weight FROM (SELECT weight, row_number() OVER (ORDER BY src, dst) - 1 AS k FROM arcs) WHERE k = 7",
        "dijkstra_directed": f"WITH RECURSIVE {_SUCC}, s AS (SELECT src AS a, dst AS b, weight FROM arcs), {_cost('s.weight', source='(SELECT min(src) FROM arcs)')} SELECT n AS id, c AS cost FROM r",
        "bfs_directed": f"WITH RECURSIVE {_SUCC}, s AS (SELECT src AS a, dst AS b FROM arcs), {_cost('1.0::DOUBLE', source='(SELECT min(src) FROM arcs)')} SELECT n AS id, c::BIGINT AS steps FROM r",
        "reached_count": f"{_DIJKSTRA} SELECT (SELECT count(*) FROM r WHERE n IN (SELECT id FROM goal)) AS reached, true AS reported",
        "corners": f"WITH {_PLACES} SELECT n_nationkey::BIGINT AS obstacle_id, CASE WHEN c IN (1, 2) THEN x1 ELSE x0 END::DOUBLE AS x, CASE WHEN c >= 2 THEN y1 ELSE y0 END::DOUBLE AS y FROM box, range(4) AS k(c)",
        "levels": heights,
        "topological_order": f"SELECT id, row_number() OVER (ORDER BY height, id) - 1 AS place FROM ({heights})",
        "reached_from": f"WITH RECURSIVE {_BASKET}, {_BOTH}, {_NODES}, {_LABELS} SELECT n AS id, m = (SELECT min(a) FROM e) AS reached FROM r",
        "neighbours": f"WITH {_SUPPLY}, {_BOTH} SELECT b AS dst, weight FROM s WHERE a = (SELECT min(a) FROM e)",
        "weight_lookup": f"""WITH {_TRADE}, q AS (SELECT n_nationkey::BIGINT AS src, unnest([(n_nationkey + 1) % 25, n_nationkey])::BIGINT AS dst FROM nation)
          SELECT src, dst, weight FROM q LEFT JOIN e ON least(src, dst) = a AND greatest(src, dst) = b""",
        "counts": f"WITH {_SUPPLY}, {_BOTH}, {_SUCC} SELECT (SELECT count(DISTINCT a) FROM s) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM ends) AS tails_and_heads, (SELECT count(*) FROM arcs) AS arcs",
        "flow_edges": drained.format(src="id AS src", dst="up AS dst", sign="", name="flow"),
        "flow_conservation": "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 0 THEN -24.0 ELSE 1.0 END::DOUBLE AS net FROM nation",
        "planar_contains": f"WITH {_PLACES} SELECT id, bool_or(x > x0 AND x < x1 AND y > y0 AND y < y1) AS inside FROM p, box GROUP BY id",
        "planar_blocks": f"WITH {_PLACES}, {_SEGMENTS} SELECT id, bool_or(CASE WHEN ax = ex AND ay = ey THEN ax > x0 AND ax < x1 AND ay > y0 AND ay < y1 ELSE {_through('xy')} END) AS blocked FROM g, box GROUP BY id",
        "visibility_edges": f"""WITH {_PLACES}, f AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM p UNION ALL
            SELECT (SELECT count(*) FROM p) + 4 * n_nationkey + c, CASE WHEN c IN (1, 2) THEN x1 ELSE x0 END, CASE WHEN c >= 2 THEN y1 ELSE y0 END FROM box, range(4) AS k(c)),
          o AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM box WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)),
          h AS (SELECT i.id AS a, j.id AS b, i.x AS ax, i.y AS ay, j.x AS ex, j.y AS ey FROM o i JOIN o j ON i.id < j.id)
          SELECT a::BIGINT AS a, b::BIGINT AS b, round(sqrt((ax-ex)*(ax-ex) + (ay-ey)*(ay-ey)), 6) AS weight FROM h
          WHERE (ax <> ex OR ay <> ey) AND sqrt((ax-ex)*(ax-ex) + (ay-ey)*(ay-ey)) <= {SIGHT} AND NOT EXISTS (SELECT 1 FROM box WHERE {_through('xy')})""",
        "planar_contains_slanted": f"WITH {_PLACES}, {_MIDDLES} SELECT id, bool_or(abs(x - mx) + abs(y - my) < 1.125) AS inside FROM p, mid GROUP BY id",
        "planar_blocks_slanted": f"WITH {_PLACES}, {_SEGMENTS}, {_MIDDLES} SELECT id, bool_or({_beside('xy')} < 1.125 - 1e-9) AS blocked FROM g, mid GROUP BY id",
        "solid_contains_slanted": f"WITH {_PLACES}, {_MIDDLES} SELECT id, bool_or(abs(x - mx) + abs(y - my) + abs(z - mz) < 1.125) AS inside FROM p, mid GROUP BY id",
        "solid_blocks_slanted": f"WITH {_PLACES}, {_SEGMENTS}, {_MIDDLES} SELECT id, bool_or({_beside('xyz')} < 1.125 - 1e-9) AS blocked FROM g, mid GROUP BY id",
        "solid_contains": f"WITH {_PLACES} SELECT id, bool_or(x > x0 AND x < x1 AND y > y0 AND y < y1 AND z > z0 AND z < z1) AS inside FROM p, box GROUP BY id",
        "solid_blocks": f"WITH {_PLACES}, {_SEGMENTS} SELECT id, bool_or(CASE WHEN ax = ex AND ay = ey AND az = ez THEN ax > x0 AND ax < x1 AND ay > y0 AND ay < y1 AND az > z0 AND az < z1 ELSE {_through('xyz')} END) AS blocked FROM g, box GROUP BY id",
        "weld_nodes": f"WITH {_PLACES}, {_SEGMENTS}, {_WELDED} SELECT id, x, y, z FROM node",
        "weld_graph": f"""WITH {_PLACES}, {_SEGMENTS}, {_WELDED} SELECT DISTINCT least(i.id, j.id) AS a, greatest(i.id, j.id) AS b,
            round(sqrt((i.x-j.x)*(i.x-j.x) + (i.y-j.y)*(i.y-j.y) + (i.z-j.z)*(i.z-j.z)), 6) AS weight
          FROM g JOIN node i ON i.u = ax AND i.v = ay AND i.w = az JOIN node j ON j.u = ex AND j.v = ey AND j.w = ez WHERE i.id <> j.id""",
        "node_features": f"""WITH {_MARKET}{_APART} SELECT score.id, links::DOUBLE AS connections, links::DOUBLE AS strength, 0.0::DOUBLE AS triangles,
            coalesce(two, 0)::DOUBLE AS within_two_steps, betweenness, {_CLOSENESS} AS closeness, (score.total - largest)::DOUBLE AS stranded,
            whole::DOUBLE AS piece_size, CASE WHEN root = 0 THEN depth ELSE -1 END::DOUBLE AS steps_to_source, CASE WHEN root = 0 THEN depth ELSE -1 END::DOUBLE AS cost_to_source
          FROM score LEFT JOIN near USING (id)""",
        "auto_method": f"WITH RECURSIVE {_BASKET}, {_BOTH}, {_NODES}, {_LABELS} SELECT n AS id, (dense_rank() OVER (ORDER BY m) - 1)::DOUBLE AS value FROM r",
        "method_dijkstra": f"{_DIJKSTRA}, {_NODES}, {_LAST} SELECT v.id, CASE WHEN {_SETTLED} THEN round(r.c, 2) END AS value FROM v LEFT JOIN r ON r.n = v.id, last",
        "method_breadth_first": f'{_STEPS} SELECT c::BIGINT AS "group", n AS id FROM r',
        "method_pieces": f'WITH {_MARKET} SELECT root AS "group", id FROM z',
        "method_cut_vertices": f"WITH {_MARKET} SELECT up AS src, id AS dst, 1.0::DOUBLE AS value FROM z WHERE up IS NOT NULL",
        "method_levels": f"{closure} SELECT DISTINCT id FROM mutual WHERE id <> other",
        "method_potential_flow": drained.format(src="up AS src", dst="id AS dst", sign="-", name="value"),
        "method_pieces_diary": f'WITH {_DIARY} SELECT (dense_rank() OVER (ORDER BY m) - 1)::BIGINT AS "group", id FROM (SELECT id, min(id) OVER (PARTITION BY c) AS m FROM o)',
        "method_cut_vertices_diary": f"""WITH {_DIARY}, cut AS (SELECT least(id, p) AS a, greatest(id, p) AS b FROM o WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chord WHERE chord.c = o.c AND lo < i AND hi >= i))
          SELECT e.a AS src, e.b AS dst, CASE WHEN cut.a IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM e LEFT JOIN cut ON cut.a = e.a AND cut.b = e.b""",
        "method_betweenness_diary": f"WITH RECURSIVE {_DIARY}, {_BOTH}, {_WAYS}, n AS (SELECT count(*) AS n FROM o) SELECT o.id, round(coalesce(sum(owed), 0) / ((max(n) - 1.0) * (max(n) - 2.0)), 10)::DOUBLE AS value FROM o LEFT JOIN passed USING (id), n GROUP BY o.id",
        "betweenness_diary_sampled": f"""WITH RECURSIVE {_DIARY}, {_BOTH}, {_WAYS}, n AS (SELECT count(*) AS n, least(64, count(*)) AS k FROM o),
          pick AS (SELECT id AS z FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM o), n WHERE i IN (SELECT t.j * n // k FROM range(64) AS t(j) WHERE t.j < k)),
          summed AS (SELECT id, sum(owed) AS owed FROM passed JOIN pick USING (z) GROUP BY id)
          SELECT o.id, round(coalesce(owed, 0), 6)::DOUBLE AS owed FROM o LEFT JOIN summed USING (id), n""",
        "method_potential_flow_trade": f"""WITH RECURSIVE {_TRADE}, {_BOTH}, w AS (SELECT a AS id, sum(weight) AS total FROM s GROUP BY a),
          x(k, id, p) AS (SELECT 0, id, 0.0::DOUBLE FROM w UNION ALL
            SELECT x.k + 1, w.id, CASE WHEN w.id = 0 THEN 0.0 ELSE (1 + sum(s.weight * x.p)) / w.total END FROM x JOIN s ON s.b = x.id JOIN w ON w.id = s.a WHERE x.k < 1000 GROUP BY x.k, w.id, w.total)
          SELECT e.a AS src, e.b AS dst, round(e.weight * (f.p - t.p), 3) AS value FROM e JOIN x f ON f.id = e.a AND f.k = 1000 JOIN x t ON t.id = e.b AND t.k = 1000""",
        "auto_choices": f"""WITH RECURSIVE {_LATTICE}, {_BOTH}, {_cost('s.weight::DOUBLE')},
          far AS (SELECT c FROM r WHERE n = 24) SELECT asked, method, c / scale AS value FROM far,
          (VALUES ('targets alone', 'Dijkstra', 1.0), ('a pair in space', 'A*', 1.0), ('a pair nothing vouches for', 'Dijkstra', 8.0), ('sources alone', 'Dijkstra', 1.0)) AS t(asked, method, scale)""",
        "method_betweenness": f"WITH {_MARKET} SELECT (row_number() OVER (ORDER BY (total * total - squares) DESC, id) - 1)::BIGINT AS rank, id FROM score WHERE total * total > squares ORDER BY rank LIMIT 10",
    }
