import math
import random

import pytest
from plain import close, column, graph, table

from tidegraph.functions import grid
from tidegraph.operators import weld as weld_module
from tidegraph.operators.planar import PlanarObstacles, visibility_graph
from tidegraph.operators.routes import shortest_routes
from tidegraph.operators.solid import SolidObstacles
from tidegraph.operators.weld import weld

SQUARE = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
CORNERS = [(x, y, z) for z in (0.0, 2.0) for y in (0.0, 2.0) for x in (0.0, 2.0)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
BOX = [f for a, b, c, d in QUADS for f in ((a, b, c), (a, c, d))]


def outlines(spark, *rings):
    return table(spark, list(enumerate(rings)), "obstacle_id bigint, ring array<struct<x: double, y: double>>")


def mesh(spark, corners=CORNERS, faces=BOX):
    return table(spark, [(0, [[float(x) for x in c] for c in corners], [list(f) for f in faces])], "obstacle_id bigint, vertices array<array<double>>, faces array<array<int>>")


def points(spark, *rows):
    names = "xyz"[: len(rows[0])]
    return table(spark, [(i, *map(float, r)) for i, r in enumerate(rows)], "id bigint, " + ", ".join(f"{c} double" for c in names))


def segments(spark, *rows):
    half = len(rows[0]) // 2
    names = [f"{e}{c}" for e in ("ab" if half == 2 else "pq") for c in "xyz"[:half]]
    return table(spark, [(i, *map(float, r)) for i, r in enumerate(rows)], "id bigint, " + ", ".join(f"{c} double" for c in names))


def test_planar_truths(spark):
    obstacles = PlanarObstacles.of(outlines(spark, [*SQUARE, SQUARE[0]]))
    assert obstacles.corners().count() == 4
    inside = column(obstacles.contains(points(spark, (0, 0), (1, 0), (1, 1), (2, 0), (0.99, 0.99))), "inside")
    assert inside == {0: True, 1: False, 2: False, 3: False, 4: True}
    cases = [
        ((-2, 0, 2, 0), True),  # through
        ((-2, 1, 2, 1), False),  # along a side
        ((-2, 2, 2, 2), False),  # past
        ((-2, 0, 0, 2), False),  # touching a corner
        ((-1, -1, 1, 1), True),  # corner to corner
        ((0, 0, 0.1, 0), True),  # wholly inside
        ((0, 0, 0, 0), True),  # a point inside
        ((5, 5, 5, 5), False),
    ]
    blocked = column(obstacles.blocks(segments(spark, *[c for c, _ in cases])), "blocked")
    assert [blocked[i] for i in range(len(cases))] == [b for _, b in cases]


def test_planar_refusals(spark):
    with pytest.raises(ValueError):
        PlanarObstacles.of(outlines(spark, SQUARE), 0)
    for ring in ([(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (float("nan"), 1.0)]):
        with pytest.raises(Exception, match="corners"):
            PlanarObstacles.of(outlines(spark, ring))


def test_visibility(spark):
    obstacles = PlanarObstacles.of(outlines(spark, SQUARE))
    seen = visibility_graph(points(spark, (-2, 0), (2, 0)), obstacles)
    assert seen.nodes.count() == 6
    cost = column(shortest_routes(seen.graph, [0]), "cost")
    assert close(cost[1], 2 + 2 * 2**0.5, 1e-9)
    near = visibility_graph(points(spark, (-2, 0), (2, 0)), obstacles, reach=2.5)
    assert {(r["a"], r["b"]) for r in near.graph.edges.collect()} == {
        (r["a"], r["b"]) for r in seen.graph.edges.collect() if r["weight"] <= 2.5
    }
    hidden = visibility_graph(points(spark, (0, 0), (2, 0)), obstacles)
    assert column(hidden.nodes, "enclosed")[0] and not column(hidden.nodes, "enclosed")[1]


def test_solid_truths(spark):
    obstacles = SolidObstacles.of(mesh(spark))
    inside = column(obstacles.contains(points(spark, (1, 1, 1), (2, 1, 1), (3, 1, 1), (0.5, 0.5, 1.9), (1, 1, 2), (0, 0, 0))), "inside")
    assert inside == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False}
    cases = [
        ((-1, 1, 1, 3, 1, 1), True),
        ((-1, 1, 2, 3, 1, 2), False),  # along the top
        ((-1, -1, 1, -1, 3, 1), False),
        ((-1, -1, -1, 3, 3, 3), True),  # corner to corner
        ((1, 1, 1, 1, 1, 1.5), True),
        ((1, 1, -1, 1, 1, 3), True),  # through the seams of two faces
    ]
    blocked = column(obstacles.blocks(segments(spark, *[c for c, _ in cases])), "blocked")
    assert [blocked[i] for i in range(len(cases))] == [b for _, b in cases]


def test_open_wall_blocks_but_holds_nothing(spark):
    wall = SolidObstacles.of(mesh(spark, [(0, 0, 0), (2, 0, 0), (2, 0, 2), (0, 0, 2)], [(0, 1, 2), (0, 2, 3)]))
    assert column(wall.blocks(segments(spark, (1, -1, 1, 1, 1, 1), (0.3, -1, 0.5, 0.3, 1, 0.5), (3, -1, 1, 3, 1, 1))), "blocked") == {0: True, 1: True, 2: False}
    assert column(wall.contains(points(spark, (1, 0, 1))), "inside") == {0: False}


def test_solid_refusals(spark):
    with pytest.raises(Exception, match="unknown vertex"):
        SolidObstacles.of(mesh(spark, faces=[(0, 1, 9)]))
    with pytest.raises(ValueError, match="no face"):
        SolidObstacles.of(mesh(spark, faces=[(0, 0, 1)]))


def lines(spark, *rows):
    return table(spark, [(i, *map(float, r)) for i, r in enumerate(rows)], "line_id bigint, ax double, ay double, az double, bx double, by double, bz double")


def test_weld_fixtures(spark):
    triangle = lines(spark, (0, 0, 0, 3, 0, 1e-4), (3, 0, 0, 0, 4, 5), (0, 4, 5, 1e-4, 0, 0))
    tight, loose = weld(triangle, 1e-3), weld(triangle, 1e-5)
    assert tight.nodes.count() == 3 and loose.nodes.count() == 5
    assert tight.graph().edge_count() == 3
    tiny = weld(lines(spark, (0, 0, 0, 1, 0, 0), (5, 5, 5, 5, 5, 5.0001)), 1e-3)
    assert column(tiny.lines, "collapsed", "line_id") == {0: False, 1: True}
    with pytest.raises(Exception, match="not finite"):
        weld(lines(spark, (0, 0, float("nan"), 1, 0, 0)), 1e-3)
    weights = table(spark, [(0, 7.0), (1, 2.0)], "line_id bigint, weight double")
    assert [r["weight"] for r in tiny.graph(weights).edges.collect()] == [7.0]


def test_weld_is_greedy(spark):
    import random

    draw = random.Random(3)
    rows = [[draw.random() * 3 for _ in range(6)] for _ in range(25)]
    t, made, ends = 0.5, [], []
    for row in rows:
        for p in (row[:3], row[3:]):
            apart = sorted((sum((a - b) ** 2 for a, b in zip(p, m)) ** 0.5, k) for k, m in enumerate(made))
            if apart and apart[0][0] <= t:
                ends.append(apart[0][1])
            else:
                ends.append(len(made))
                made.append(p)
    found = weld(lines(spark, *rows), t)
    assert {r["line_id"]: (r["from"], r["to"]) for r in found.lines.collect()} == {i: (ends[2 * i], ends[2 * i + 1]) for i in range(25)}
    assert found.nodes.count() == len(made)
    assert graph(spark, 2, []).edge_count() == 0


@pytest.mark.parametrize("axes", [2, 3])
def test_cells_along_a_line(spark, axes):
    """Every cell a segment passes is listed, and no more than a few for each of its length."""
    draw = random.Random(axes)
    names = "xyz"[:axes]
    rows = [(i, *[draw.uniform(-9, 9) for _ in range(axes)], *[draw.uniform(-9, 9) for _ in range(axes)]) for i in range(150)]
    rows += [(200, *[1.5] * axes, *[1.5] * axes), (201, *[0.0] * axes, *[5.0] * axes), (202, *[2.0] * axes, 7.0, *[2.0] * (axes - 1))]
    start, end = [f"a{c}" for c in names], [f"b{c}" for c in names]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in start + end))
    side = 0.7
    found = {}
    for r in grid.along_cells(df, start, end, side).collect():
        found.setdefault(r["id"], set()).add(tuple(r[f"cell{k}"] for k in range(axes)))
    for i, *at in rows:
        a, b = at[:axes], at[axes:]
        passed = {tuple(math.floor((p + t / 4000 * (q - p)) / side) for p, q in zip(a, b)) for t in range(4001)}
        assert passed <= found[i]
        longest = max(abs(q - p) for p, q in zip(a, b)) / side
        assert len(found[i]) <= (longest + 3) * 3 ** (axes - 1)


def test_a_long_slanted_line_takes_few_cells(spark):
    """A thousand cells across: thousands of rows, not a million."""
    df = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 700.0)], "id bigint, ax double, ay double, bx double, by double")
    n = grid.along_cells(df, ["ax", "ay"], ["bx", "by"], 1.0).count()
    assert 1700 <= n < 2100


def test_a_long_row_of_close_ends(spark, monkeypatch):
    """10,000 ends in a row, each within tolerance of the next: every second one makes a node, in a few rounds."""
    n, written = 5000, []
    plain_staged = weld_module.staged
    monkeypatch.setattr(weld_module, "staged", lambda df, name="state": written.append(name) or plain_staged(df, name))
    lines = spark.range(n).selectExpr("id as line_id", "1.6 * id as ax", "0d as ay", "0d as az", "1.6 * id + 0.8 as bx", "0d as by", "0d as bz")
    network = weld(lines, 1.0)
    assert network.nodes.count() == n and network.nodes.where("abs(x - 1.6 * id) > 1e-6").isEmpty()
    assert network.lines.where("not collapsed").isEmpty()
    assert written.count("makers") < 20 and written.count("rows") < 20


@pytest.mark.parametrize("seed", range(3))
def test_weld_against_plain(spark, seed):
    """Crowded ends, whose makers hang on each other in rows and forks, one after another by hand."""
    draw = random.Random(seed)
    rows = [(i, *[round(draw.uniform(0, 6 + 3 * seed), 2) for _ in range(6)]) for i in range(150)]
    t, nodes, expected = 0.9, [], {}
    for i, *at in rows:
        own = []
        for place in (at[:3], at[3:]):
            best = min(((math.dist(place, q), k) for k, q in enumerate(nodes) if math.dist(place, q) <= t), default=None)
            if best is None:
                nodes.append(place)
            own.append(len(nodes) - 1 if best is None else best[1])
        expected[i] = (*own, own[0] == own[1])
    found = weld(table(spark, rows, "line_id bigint, ax double, ay double, az double, bx double, by double, bz double"), t)
    assert {r["line_id"]: (r["from"], r["to"], r["collapsed"]) for r in found.lines.collect()} == expected
    assert [[r["x"], r["y"], r["z"]] for r in found.nodes.orderBy("id").collect()] == nodes


def test_places_are_asked_once(spark, monkeypatch):
    """Many nodes at few places: sight is a question about two places, and each edge is listed."""
    asked, inner = [], PlanarObstacles.blocks

    def watched(self, segments):
        asked.append(segments.count())
        return inner(self, segments)

    monkeypatch.setattr(PlanarObstacles, "blocks", watched)
    places = [(-2, 0), (2, 0), (2, 3)]
    seen = visibility_graph(points(spark, *[places[i % 3] for i in range(12)]), PlanarObstacles.of(outlines(spark, SQUARE)), reach=4.5)
    assert asked[0] <= 7 * 6 / 2
    got = {(r["a"], r["b"]): r["weight"] for r in seen.graph.edges.collect()}
    assert all(got.get((i, j)) == (3.0 if {i % 3, j % 3} == {1, 2} else None) for j in range(12) for i in range(j))
    assert sum(k[1] < 12 for k in got) == 16
