import random
import shutil
from collections import Counter

import numpy as np
import pytest
from plain import cheapest, close, column, digraph, graph, levels, pieces, table
from pyspark.sql import functions as F

from tidegraph.graph import DiGraph, Graph
from tidegraph.operators import centrality, chains, components, condensation, cuts, features, flow, routes, tours, trimming
from tidegraph.plans import rounds

#: A ladder of four rungs with a tail: sides 0 2 4 6 and 1 3 5 7, tail 7 8 9.
LADDER = [(0, 2), (2, 4), (4, 6), (1, 3), (3, 5), (5, 7), (0, 1), (2, 3), (4, 5), (6, 7), (7, 8), (8, 9)]


def random_pairs(seed, n, m):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n), draw.choice([1, 2, 2, 3])) for _ in range(m)]


def test_components(spark):
    pairs = random_pairs(1, 60, 45)
    low = pieces(60, pairs)
    assert column(components.connected_components(graph(spark, 60, pairs)), "lowest") == dict(enumerate(low))
    number = {r: i for i, r in enumerate(sorted(set(low)))}
    assert column(components.numbered_components(graph(spark, 60, pairs)), "component") == {i: number[r] for i, r in enumerate(low)}
    assert column(components.numbered_components(graph(spark, 3, [])), "component") == {0: 0, 1: 1, 2: 2}
    long = [(i, i + 1) for i in range(0, 900)] + [(2000, i) for i in range(2001, 2400)]
    ids = table(spark, [(i,) for p in long for i in p], "id bigint")
    found = column(components.connected_components(Graph.of(spark, ids, table(spark, long, "a bigint, b bigint"))), "lowest")
    assert set(found.values()) == {0, 2000} and found[900] == 0 and found[2399] == 2000


def test_routes_on_a_ladder(spark):
    weighed = [(a, b, 1 + (a * b) % 3) for a, b in LADDER]
    g = graph(spark, 11, weighed)
    expected = cheapest(11, [(*p, float(w)) for a, b, w in weighed for p in ((a, b), (b, a))], [3, 9])
    tree = routes.shortest_routes(g, [9, 3])
    assert {r["id"]: (r["cost"], r["source"]) for r in tree.collect()} == {k: v[:2] for k, v in expected.items()}

    def back(x):
        return [*back(expected[x][2]), x] if expected[x][2] >= 0 else [x]

    traced = column(routes.routes_to(tree, table(spark, [(0,), (6,), (10,)], "id bigint")), "route", "end")
    assert traced == {0: back(0), 6: back(6), 10: []}
    walled = routes.shortest_routes(graph(spark, 10, LADDER), [0], lambda s, d, w: F.when(d == 7, float("inf")).otherwise(w))
    assert set(column(walled, "cost")) == set(range(7))
    with pytest.raises(Exception, match="not allowed"):
        routes.shortest_routes(digraph(spark, 4, [(2, 3, -0.5)]), [2]).collect()
    with pytest.raises(ValueError):
        routes.shortest_routes(g, [11])


def test_early_stop(spark):
    arcs = [(*p, float(w)) for a, b, w in random_pairs(41, 30, 70) for p in ((a, b), (b, a)) if a != b]
    low = {}
    for a, b, w in arcs:
        low[a, b] = max(w, low.get((a, b), w))
    whole = cheapest(30, [(a, b, w) for (a, b), w in low.items()], [2])
    goals = sorted(whole, key=lambda k: (whole[k][0], k))[8:11:2]
    last = max((whole[k][0], k) for k in goals)
    found = column(routes.shortest_routes(graph(spark, 30, [(a, b, w) for (a, b), w in low.items()]), [2], targets=goals), "cost")
    assert found == {k: c for k, (c, _, _) in whole.items() if (c, k) <= last}
    apart = column(routes.shortest_routes(graph(spark, 11, LADDER), [4], targets=[5, 10]), "cost")
    assert apart == {k: float(v) for k, v in levels(11, LADDER, 4).items()}  # 10 is out of reach, so nothing is cut off


@pytest.mark.parametrize("seed", range(3))
def test_routes_against_queue(spark, seed):
    arcs = [(a, b, w) for a, b, w in random_pairs(seed, 25, 60) if a != b]
    low = {}
    for a, b, w in arcs:
        low[a, b] = min(w, low.get((a, b), w))
    expected = cheapest(25, [(a, b, float(w)) for (a, b), w in low.items()], [0, 7])
    tree = routes.shortest_routes(digraph(spark, 25, arcs), [7, 0]).collect()
    assert {r["id"]: (r["cost"], r["source"], -1 if r["previous"] is None else r["previous"]) for r in tree} == expected
    steps = column(routes.breadth_first(digraph(spark, 25, arcs), [0, 7]), "steps")
    assert steps == {k: int(c) for k, (c, _, _) in cheapest(25, [(a, b, 1.0) for a, b in low], [0, 7]).items()}


def test_free_steps_make_no_loops(spark):
    """Two rings of steps that cost nothing, and ways through them."""
    free = [(a, b, 0) for ring in ((1, 2, 3), (4, 5)) for a, b in zip(ring, ring[1:] + ring[:1])]
    d = digraph(spark, 8, [(0, 2, 2), (3, 5, 1), (4, 6, 3), (6, 0, 1), (7, 6, 1), *free])
    tree = routes.shortest_routes(d, [0])
    assert column(tree, "cost") == {0: 0, 1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 6}
    assert column(routes.routes_to(tree, table(spark, [(6,)], "id bigint")), "route", "end") == {6: [0, 2, 3, 5, 4, 6]}
    h = table(spark, [(i, 0.0) for i in range(8)], "id bigint, h double")
    found, _ = routes.goal_route(d, 0, 6, h)
    assert column(found, "cost")[6] == 6.0


def test_goal_route(spark):
    n = 8
    cell = lambda r, c: r * n + c
    walls = {(4, c) for c in range(6)}
    pairs = [
        (cell(r, c), cell(r + dr, c + dc))
        for r in range(n) for c in range(n) for dr, dc in ((0, 1), (1, 0))
        if r + dr < n and c + dc < n and (r, c) not in walls and (r + dr, c + dc) not in walls
    ]
    g = graph(spark, n * n, pairs)
    goal = cell(7, 1)
    h = table(spark, [(cell(r, c), float(abs(r - 7) + abs(c - 1))) for r in range(n) for c in range(n)], "id bigint, h double")
    found, looked = routes.goal_route(g, cell(1, 1), goal, h)
    assert column(found, "cost")[goal] == levels(n * n, pairs, cell(1, 1))[goal]
    assert found.count() == column(found, "cost")[goal] + 1
    none, _ = routes.goal_route(graph(spark, 3, [(0, 1)]), 0, 2, table(spark, [(i, 0.0) for i in range(3)], "id bigint, h double"))
    assert none.count() == 0


def plain_betweenness(n, pairs):
    near = {i: sorted({b if a == i else a for a, b, *_ in pairs if i in (a, b) and a != b}) for i in range(n)}
    total = [0.0] * n
    for s in range(n):
        far, paths, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in near[x]:
                if y not in far:
                    far[y], paths[y] = far[x] + 1, 0.0
                    order.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
        owed = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if far.get(x, -1) == far[y] - 1:
                    owed[x] += paths[x] / paths[y] * (1 + owed[y])
            if y != s:
                total[y] += owed[y]
    return [t / 2 / ((n - 1) * (n - 2) / 2) for t in total]


def test_pieces_of_the_core_are_found_once(spark, monkeypatch):
    """Betweenness and closeness of one trimmed graph ask for the same pieces."""
    found, pieces_of = [], trimming.connected_components
    monkeypatch.setattr(trimming, "connected_components", lambda core: found.append(core) or pieces_of(core))
    pairs = [(i, (i + 1) % 6) for i in range(6)] + [(i, 6 + i) for i in range(6)]
    g = graph(spark, 12, pairs)
    trimmed = trimming.trim(g, g.vertices.withColumnRenamed("id", "origin"))
    between = column(centrality.betweenness(g, trimmed=trimmed), "betweenness")
    assert trimmed.peeled and all(close(between[i], v) for i, v in enumerate(plain_betweenness(12, pairs)))
    near = column(centrality.closeness(g, trimmed=trimmed), "closeness")
    assert len(found) == 1 and close(near[0], 11 / (2 * (1 + 2) + 3 + 1 + 2 * (2 + 3) + 4))


def test_small_pieces_are_not_followed_level_by_level(spark, monkeypatch):
    """Pieces of three sizes, the largest with hanging trees too; only nodes of the largest are origins of levels."""
    draw, pairs, n = random.Random(8), [], 0
    for size in (9, 30, 70):
        pairs += [(n + i, n + (i + 1) % size) for i in range(size)] + [(n + draw.randrange(size), n + draw.randrange(size)) for _ in range(size // 3)]
        n += size
    pairs += [(109 - draw.randrange(60), n + i) for i in range(30)]
    n += 31
    followed, levels = [], centrality.shortest_path_levels

    def counted(core, origins):
        followed.append({r[0] for r in origins.select("origin").collect()})
        return levels(core, origins)

    monkeypatch.setattr(centrality, "shortest_path_levels", counted)
    found = column(centrality.betweenness(graph(spark, n, pairs)), "betweenness")
    assert all(close(found[i], v) for i, v in enumerate(plain_betweenness(n, pairs)))
    assert followed and all(min(f) >= 39 for f in followed)


def test_betweenness(spark):
    for n, pairs in ((10, LADDER), (24, random_pairs(42, 24, 40))):
        found = column(centrality.betweenness(graph(spark, n, pairs)), "betweenness")
        assert all(close(found[i], v) for i, v in enumerate(plain_betweenness(n, pairs)))
    top = centrality.busiest(table(spark, [(i, [0.0, 0.4, 0.1, 0.4, 0.2][i]) for i in range(5)], "id bigint, betweenness double"), 3)
    assert [r["id"] for r in top.collect()] == [1, 3, 4]
    ring = [(i, (i + 1) % 45) for i in range(45)]
    part = column(centrality.betweenness(graph(spark, 45, ring), 15), "betweenness")
    exact = plain_betweenness(45, ring)[0]
    assert abs(sum(part.values()) / 45 / exact - 1) < 0.01


def test_closeness_against_plain(spark):
    pairs = [(a, b) for a, b, _ in random_pairs(5, 20, 22) if a != b]
    found = column(centrality.closeness(graph(spark, 20, pairs)), "closeness")
    for i in range(20):
        far = [v for k, v in levels(20, pairs, i).items() if k != i]
        assert close(found[i], len(far) / 19 * len(far) / sum(far) if far else 0.0)


def test_triangles_and_two_steps(spark):
    pairs = [(a, b) for a, b, _ in random_pairs(6, 18, 50) if a != b]
    edges = {(min(p), max(p)) for p in pairs}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(18)}
    g = graph(spark, 18, pairs)
    tri, two = column(centrality.triangles(g), "triangles"), column(centrality.within_two_steps(g), "within_two")
    for i in range(18):
        k = len(near[i])
        closed = sum((a, b) in edges for a in near[i] for b in near[i] if a < b)
        assert close(tri[i], 2 * closed / (k * (k - 1)) if k > 1 else 0.0)
        assert two[i] == len({y for x in near[i] for y in near[x]} | near[i] - {i}) - (1 if near[i] else 0)


def test_triangles_keep_edges(spark, tmp_path):
    """Edges are read before the answer is asked for, and never again."""
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)]
    table(spark, [(a, b, 1.0) for a, b in pairs], "a bigint, b bigint, weight double").write.parquet(f"{tmp_path}/edges")
    found = centrality.triangles(Graph(spark.range(7), spark.read.parquet(f"{tmp_path}/edges")))
    shutil.rmtree(f"{tmp_path}/edges")
    tri = column(found, "triangles")
    assert all(close(tri[i], v) for i, v in enumerate((1.0, 1.0, 1 / 3, 1.0, 1 / 3, 0.0, 0.0)))


def cut(spark, n, pairs):
    stranded, bridges = cuts.cut_structure(graph(spark, n, pairs))
    found = column(stranded, "stranded")
    return [found[i] for i in range(n)], sorted(tuple(r) for r in bridges.collect())


def test_cuts_of_a_ladder_and_a_hub(spark):
    assert cut(spark, 11, LADDER) == ([0, 0, 0, 0, 0, 0, 0, 2, 1, 0, 0], [(7, 8), (8, 9)])
    wheel = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 20)]
    stranded, bridges = cut(spark, 40, wheel)
    assert stranded == [19, *[0] * 39] and bridges == [(0, i) for i in range(21, 40)]


@pytest.mark.parametrize("seed", range(3))
def test_cuts_against_removal(spark, seed):
    n = 22
    pairs = [(a, b) for a, b, _ in random_pairs(seed + 20, n, 26) if a != b]
    stranded, bridges = cut(spark, n, pairs)
    whole = pieces(n, pairs)
    for x in range(n):
        left = pieces(n, pairs, without=x)
        sizes = [sum(left[j] == r for j in range(n) if j != x and whole[j] == whole[x]) for r in {left[j] for j in range(n) if j != x and whole[j] == whole[x]}]
        assert stranded[x] == (sum(sizes) - max(sizes) if sizes else 0)
    edges = sorted({(min(p), max(p)) for p in pairs})
    plain = [e for e in edges if len(set(pieces(n, [f for f in edges if f != e]))) > len(set(whole))]
    assert bridges == plain


def test_small_pieces_are_cut_whole(spark, monkeypatch):
    """Small pieces, and a hub with too many neighbours for that: only it goes by rounds."""
    n = 115
    few = [(a, b) for a, b, _ in random_pairs(31, 40, 44) if a != b]
    pairs = few + [(40, k) for k in range(41, 112)] + [(41, 42), (111, 112)]
    seen, inner = [], cuts.spanning_forest

    def watched(graph, pieces, *most):
        seen.append(pieces.count())
        return inner(graph, pieces, *most)

    monkeypatch.setattr(cuts, "spanning_forest", watched)
    stranded, bridges = cut(spark, n, pairs)
    assert seen == [73]
    whole = pieces(n, pairs)
    for x in range(n):
        left = pieces(n, pairs, without=x)
        sizes = list(Counter(left[j] for j in range(n) if j != x and whole[j] == whole[x]).values())
        assert stranded[x] == (sum(sizes) - max(sizes) if sizes else 0)
    edges = sorted({(min(p), max(p)) for p in pairs})
    assert bridges == [e for e in edges if len(set(pieces(n, [f for f in edges if f != e]))) > len(set(whole))]


def test_condensation(spark):
    def run(n, arcs):
        rows = condensation.condensation(digraph(spark, n, arcs)).collect()
        return {r["id"]: (r["component"], r["height"]) for r in rows}

    stairs = [(a, b) for a in range(9) for b in range(a) if (a * b + a) % 4 == 1]
    tall = [0] * 9
    for a, b in stairs:
        tall[a] = max(tall[a], tall[b] + 1)
    found = run(9, stairs)
    assert {i: found[i][1] for i in range(9)} == dict(enumerate(tall))
    dag = condensation.condensation(digraph(spark, 9, stairs))
    assert [r["id"] for r in condensation.topological_order(dag).collect()] == sorted(range(9), key=lambda i: (tall[i], i))
    assert condensation.is_acyclic(dag) and not condensation.is_acyclic(condensation.condensation(digraph(spark, 3, [(0, 2), (2, 0)])))
    # Two rings, one leading to the other, and nodes before, between and behind.
    rings = [(7, 3), (3, 5), (5, 7), (5, 2), (2, 4), (4, 6), (6, 4), (6, 0), (1, 7)]
    assert run(8, rings) == {0: (0, 0), 1: (1, 4), 2: (2, 2), 3: (3, 3), 4: (4, 1), 5: (3, 3), 6: (4, 1), 7: (3, 3)}
    arcs = [(a, b) for a, b, _ in random_pairs(9, 20, 30) if a != b]
    reach = {i: set(cheapest(20, [(a, b, 1.0) for a, b in arcs], [i])) for i in range(20)}
    low = [min(j for j in range(20) if j in reach[i] and i in reach[j]) for i in range(20)]
    strong = column(condensation.strong_components(digraph(spark, 20, arcs)), "lowest")
    assert [strong[i] for i in range(20)] == low


def test_long_chain_and_ring(spark):
    """A chain of 200,000 nodes beside a ring of as many, in no order along either."""
    n = 200_000
    at = f"(id * 7919) % {n}"
    on = f"((id + 1) * 7919) % {n}"
    chain = spark.range(n - 1).selectExpr(f"{at} as a", f"{on} as b")
    ring = spark.range(n).selectExpr(f"{at} + {n} as a", f"{on} + {n} as b")
    found = condensation.condensation(DiGraph.of(spark, 2 * n, chain.union(ring)))
    place = spark.range(n).selectExpr(f"{at} as id", f"{n - 1} - id as expected")
    assert found.join(place, "id").where("height = expected and component = id").count() == n
    rest = found.where(f"id >= {n}").agg(F.min("component"), F.max("component"), F.max("height"), F.count("*")).first()
    assert rest[:] == (n, n, 0, n)
    assert not condensation.is_acyclic(found)


def test_bridges_of_a_long_path(spark):
    """A path of 100,000 nodes in no order, whose rounds must not follow its length."""
    n = 100_000
    edges = spark.range(n - 1).selectExpr(f"(id * 7919) % {n} as a", f"((id + 1) * 7919) % {n} as b")
    g = Graph.of(spark, n, edges)
    stranded, bridges = cuts.cut_structure(g)
    assert bridges.count() == n - 1
    expected = spark.range(n).selectExpr(f"(id * 7919) % {n} as id", f"least(id, {n} - 1 - id) as expected")
    assert stranded.join(expected, "id").where("stranded = expected").count() == n


@pytest.mark.parametrize("seed", range(4))
def test_tours_and_sweeps_agree(spark, seed):
    """Any forest and any depth give the same cuts: by tours, by sweeps, and by taking nodes away."""
    n = 24
    pairs = [(a, b) for a, b, _ in random_pairs(60 + seed, n, 26 + 4 * seed) if a != b]
    g = graph(spark, n, pairs)
    found = [cuts.cut_structure(g, shallow) for shallow in (0, 100)]
    bridges = [sorted((r["a"], r["b"]) for r in f[1].collect()) for f in found]
    stranded = [column(f[0], "stranded") for f in found]
    assert bridges[0] == bridges[1] and stranded[0] == stranded[1]
    whole = pieces(n, pairs)
    for v in range(n):
        rest = [x for i, x in enumerate(pieces(n, pairs, without=v)) if i != v and whole[i] == whole[v]]
        sizes = [rest.count(x) for x in set(rest)]
        assert stranded[0][v] == (sum(sizes) - max(sizes) if sizes else 0)


def test_euler_numbers_and_subtree_ranges(spark, monkeypatch):
    """A hub whose arcs are ordered in many buckets, and drawn trees, by plain walks."""
    monkeypatch.setattr(tours, "BUCKET_ROWS", 3)
    draw = random.Random(8)
    edges = [(0, i) for i in range(1, 30)] + [(draw.randrange(30, i), i) for i in range(31, 70)]
    low = pieces(72, edges)
    g = graph(spark, 72, edges)
    nodes = {r["id"]: r for r in tours.euler_numbers(components.connected_components(g), tours.spanning_edges(g)).collect()}
    assert sorted(r["pre"] for r in nodes.values()) == list(range(72))
    inside = {i: {j for j in nodes if nodes[i]["pre"] <= nodes[j]["pre"] < nodes[i]["pre"] + nodes[i]["size"]} for i in nodes}
    for i, r in nodes.items():
        assert r["root"] == low[i] and inside[i] == {i}.union(*(inside[j] for j in nodes if nodes[j]["parent"] == i))
        assert (r["parent"] is None) == (i == low[i])
        assert r["parent"] is None or tuple(sorted((i, r["parent"]))) in edges
    values = {i: (draw.randrange(1000), draw.randrange(1000)) for i in draw.sample(range(72), 20)}
    table_ = table(spark, [(nodes[i]["pre"], a, b) for i, (a, b) in values.items()], "pre bigint, lo bigint, hi bigint")
    asked = table(spark, [(i, r["pre"], r["size"]) for i, r in nodes.items()], "id bigint, pre bigint, size bigint")
    found = {r["id"]: (r["low"], r["high"]) for r in tours.subtree_range(asked, table_).collect()}
    expected = {i: (min(values[j][0] for j in inside[i] & set(values)), max(values[j][1] for j in inside[i] & set(values))) for i in nodes if inside[i] & set(values)}
    assert found == expected


def test_words_of_origins(spark):
    """More origins than a word has bits, a sample of them, and pieces out of reach."""
    pairs = [(a, b) for a, b, _ in random_pairs(71, 150, 170) if a != b]
    g = graph(spark, 150, pairs)
    for most in (2000, 70, 1):
        origins, k, n = centrality.spread_sources(g, most)
        by_levels = column(centrality.closeness(g, most, centrality.shortest_path_levels(g, origins)), "closeness")
        assert column(centrality.closeness(g, most), "closeness") == by_levels and any(by_levels.values())
    origins = centrality.spread_sources(g, 2000)[0]
    sums = {r["node"]: (r["reached"], r["total"]) for r in centrality.distance_sums(g, origins).collect()}
    for i in range(0, 150, 7):
        far = levels(150, pairs, i)
        assert sums.get(i, (0, 0)) == (len(far) - 1, sum(far.values()))


def test_words_hold_whole_pieces(spark, monkeypatch):
    """Pieces whose ids lie far apart share words, and words in which nothing is new are put aside."""
    sizes, inner = [], centrality.staged

    def watched(df, name="state"):
        out = inner(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(centrality, "staged", watched)
    rings = [(i + 256 * k, i + 256 * ((k + 1) % 4)) for i in range(256) for k in range(4)]
    path = [(a, a + 1) for a in range(2000, 2020)] + [(a, a + 2) for a in range(2000, 2019)]
    g = Graph.of(spark, table(spark, [(x,) for p in rings + path for x in p], "id bigint"), table(spark, rings + path, "a bigint, b bigint"))
    sums = {r["node"]: (r["reached"], r["total"]) for r in centrality.distance_sums(g, g.vertices.withColumnRenamed("id", "origin")).collect()}
    assert all(sums[i] == (3, 4) for i in range(1024))
    assert all(sums[2000 + i] == (20, sum((abs(i - j) + 1) // 2 for j in range(21))) for i in range(21))
    assert max(k for name, k in sizes if name == "words") <= 1024 + 21 and ("ended", 1024) in sizes


def test_ranks_of_lists(spark):
    """Drawn lists and rings with weights, by plain walks."""
    draw = random.Random(11)
    rows, expected, ids = [], {}, list(range(300))
    draw.shuffle(ids)
    while ids:
        part = [ids.pop() for _ in range(min(len(ids), draw.choice([1, 2, 3, 40])))]
        weights = [draw.randrange(5) for _ in part]
        ring = draw.random() < 0.4
        outside = (None, None) if ring else (draw.choice([None, -1]), draw.choice([None, 900]))
        for k, x in enumerate(part):
            first, last = k == 0 and not ring, k == len(part) - 1 and not ring
            rows.append((x, None if first else part[k - 1], None if last else part[(k + 1) % len(part)],
                         outside[0] if first else None, outside[1] if last else None, weights[k]))
            expected[x] = (*outside, min(part), ring, None if ring else sum(weights[k:]))
    links = table(spark, rows, "id bigint, prev bigint, next bigint, first bigint, last bigint, weight bigint")
    assert {r[0]: tuple(r[1:]) for r in chains.ranked_lists(links).select("id", "first", "last", "low", "ring", "rank").collect()} == expected
    assert chains.ranked_lists(links.limit(0)).count() == 0


def test_lists_that_have_ended_are_not_carried_on(spark, monkeypatch):
    """One long list among many short ones: rounds hold what is left of the long one."""
    sizes = []

    def counted(df, name="state", lying=None):
        out = rounds.staged(df, name, lying)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(chains, "staged", counted)
    rows = [(i, i - 1 if i else None, i + 1 if i < 99 else None) for i in range(100)] + [(1000 + i, None, None) for i in range(400)]
    rows += [(x, y, z) for i in range(400) for x, y, z in ((2000 + 2 * i, None, 2001 + 2 * i), (2001 + 2 * i, 2000 + 2 * i, None))]
    links = table(spark, [(*r, None, None, 1) for r in rows], "id bigint, prev bigint, next bigint, first bigint, last bigint, weight bigint")
    found = column(chains.ranked_lists(links), "rank")
    assert found == {i: 100 - i for i in range(100)} | {1000 + i: 1 for i in range(400)} | {2000 + i: 2 - i % 2 for i in range(800)}
    lists = [k for name, k in sizes if name == "lists"]
    assert lists[0] == 1300 and lists[1] <= 900 and lists[2] <= 100


@pytest.mark.parametrize("arcs, acyclic", [
    ([], True),
    ([(0, 1), (1, 0)], False),
    ([(0, 1), (1, 2), (2, 3), (3, 1)], False),
    # Both ways out of 0 lead back to it over a node that is merely passed.
    ([(0, 1), (1, 0), (0, 2), (2, 0)], False),
    ([(i, i + 1) for i in range(60)], True),
    ([(i, i + 1) for i in range(30)] + [(i, 40 + i) for i in range(30)], True),
    ([(i, j) for i in range(12) for j in range(i)], True),
    ([(i, j) for i in range(12) for j in range(i)] + [(0, 11)], False),
    # A cycle of nodes with several arcs each, behind and before long paths.
    ([(0, 1), (1, 2), (2, 0), (2, 1), (0, 2)] + [(i, i + 1) for i in range(2, 20)] + [(i + 1, i) for i in range(30, 40)] + [(30, 0)], False),
])
def test_cycles_are_seen_without_components(spark, arcs, acyclic):
    assert condensation.has_no_cycle(digraph(spark, 80, arcs)) is acyclic


def test_size_estimates_do_not_grow(spark):
    """What the planner thinks of a state is its size, after twenty rounds as after one."""
    sizes, state = [], spark.range(500).selectExpr("id", "(id + 1) % 500 as next")
    for _ in range(20):
        on = state.selectExpr("id as next", "next as next2")
        state = rounds.staged(state.join(on, "next").selectExpr("id", "next2 as next"))
        sizes.append(int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert max(sizes) < 4 * min(sizes)


@pytest.mark.parametrize("seed", range(2))
def test_components_and_heights_with_chains(spark, seed):
    """Rings and forks joined by long chains, against plain reachability."""
    draw = random.Random(60 + seed)
    arcs, n = [], 12
    for _ in range(18):
        a, b = draw.randrange(12), draw.randrange(12)
        path = [a, *range(n, n + draw.choice([0, 0, 1, 2, 5])), b]
        n = max(n, max(path) + 1)
        arcs += [(x, y) for x, y in zip(path, path[1:]) if x != y]
    arcs += [(n, n + 1), (n + 1, n + 2), (n + 2, n)]  # a ring by itself
    n += 3
    reach = {i: set(cheapest(n, [(a, b, 1.0) for a, b in arcs], [i])) for i in range(n)}
    low = [min(j for j in reach[i] if i in reach[j]) for i in range(n)]
    rows = condensation.condensation(digraph(spark, n, arcs)).collect()
    number = {r: i for i, r in enumerate(sorted(set(low)))}
    assert {r["id"]: r["component"] for r in rows} == {i: number[low[i]] for i in range(n)}
    between = {(low[a], low[b]) for a, b in arcs if low[a] != low[b]}

    def tall(x):
        return max((1 + tall(b) for a, b in between if a == x), default=0)

    assert {r["id"]: r["height"] for r in rows} == {i: tall(low[i]) for i in range(n)}


def test_flow(spark):
    """Potentials against a dense solve, on cycles, with two grounds and a piece that has none."""
    pairs = [(a, b, w) for a, b, w in random_pairs(43, 12, 26) if a != b] + [(12, 13, 2)]
    g = graph(spark, 14, pairs)
    weight = np.zeros((14, 14))
    for a, b, w in pairs:
        weight[a, b] = weight[b, a] = max(w, weight[a, b])
    reached = [i for i, r in enumerate(pieces(14, pairs)) if r in (pieces(14, pairs)[0], pieces(14, pairs)[5])]
    free = [i for i in reached if i not in (0, 5)]
    amounts = np.array([(i * 7) % 5 - 1.5 for i in range(14)])
    laplace = np.diag(weight.sum(1)) - weight
    wanted = np.linalg.solve(laplace[np.ix_(free, free)], amounts[free])
    found = flow.potential_flow(g, table(spark, [(i, float(a)) for i, a in enumerate(amounts)], "id bigint, amount double"), table(spark, [(0,), (5,)], "id bigint"))
    p = column(found.potentials, "potential")
    assert found.converged and p[0] == p[5] == 0 and all(close(p[i], v, 1e-7) for i, v in zip(free, wanted))
    assert all(p[i] is None for i in range(14) if i not in reached)
    sent = {(r["src"], r["dst"]): r["flow"] for r in flow.edge_flow(g.both_ways(), found.potentials).collect()}
    assert all(close(f, weight[a, b] * (p[a] - p[b]) if p[a] is not None else 0.0, 1e-7) for (a, b), f in sent.items())


def test_features(spark):
    weighed = [(a, b, 1 + (a + b) % 4) for a, b in LADDER]
    got = features.node_features(graph(spark, 12, [*weighed, (10, 11, 2.5)]), [4])
    rows = {r["id"]: r for r in got.table.collect()}
    steps = levels(12, LADDER, 4)
    costs = cheapest(12, [(*p, float(w)) for a, b, w in weighed for p in ((a, b), (b, a))], [4])
    assert [rows[i]["Steps To Source"] for i in range(12)] == [steps.get(i, -1) for i in range(12)]
    assert [rows[i]["Cost To Source"] for i in range(12)] == [costs[i][0] if i in costs else -1 for i in range(12)]
    assert [rows[i]["Strength"] for i in range(10)] == [sum(w for a, b, w in weighed if i in (a, b)) for i in range(10)]
    assert [rows[i]["Stranded"] for i in range(12)] == [0, 0, 0, 0, 0, 0, 0, 2, 1, 0, 0, 0]
    assert [rows[i]["Piece Size"] for i in (0, 11)] == [10, 2]
    assert got.table.columns == ["id", *features.FEATURES] and len(got.remarks) == 1


def test_features_take_what_is_asked(spark, monkeypatch):
    """No path is followed for readings that nobody asks for, and pieces are found once."""
    g = graph(spark, 12, LADDER)
    names = ("Strength", "Stranded", "Piece Size", "Steps To Source")
    whole = sorted(map(tuple, features.node_features(g, [4]).table.select("id", *names).collect()))
    found, inner = [], features.connected_components

    def watched(graph):
        found.append(graph)
        return inner(graph)

    for module in (features, cuts):
        monkeypatch.setattr(module, "connected_components", watched)
    monkeypatch.setattr(features, "trim", None)
    got = features.node_features(g, [4], readings=names).table
    assert got.columns == ["id", *names] and sorted(map(tuple, got.collect())) == whole
    assert len(found) == 1


def test_features_follow_every_node(spark):
    """A hub with 2,100 branches, the first of which has a leaf more: closeness is not estimated from some of the nodes."""
    n = 2102
    got = features.node_features(graph(spark, n, [(0, k) for k in range(1, n - 1)] + [(1, n - 1)]))
    rows = {r["id"]: r for r in got.table.select("id", "Betweenness", "Closeness").collect()}
    total = {0: n, 1: 2 + 2 * (n - 3), n - 1: 3 + 3 * (n - 3), 2: 1 + 2 * (n - 3) + 3}
    assert all(close(rows[i]["Closeness"], (n - 1) / v) for i, v in total.items())
    pairs = (n - 1) * (n - 2) / 2
    assert close(rows[0]["Betweenness"], (pairs - 1) / pairs) and close(rows[1]["Betweenness"], (n - 2) / pairs)
    assert not any("estimated" in r for r in got.remarks)


def test_trees_are_taken_off(spark, monkeypatch):
    """Trees on a core, a lone edge, a lone node: paths are followed in the core alone."""
    core = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 2)]
    trees = [(k % 6, k) for k in range(6, 40)] + [(6 + k % 5, k) for k in range(40, 60)] + [(60, 61)]
    n, pairs = 63, core + trees
    g = graph(spark, n, pairs)
    followed, inner = [], centrality.shortest_path_levels

    def watched(graph, origins):
        levels = inner(graph, origins)
        followed.append(sum(f.count() for f in levels))
        return levels

    monkeypatch.setattr(centrality, "shortest_path_levels", watched)
    found, near = column(centrality.betweenness(g), "betweenness"), column(centrality.closeness(g), "closeness")
    assert all(close(found[i], v) for i, v in enumerate(plain_betweenness(n, pairs)))
    assert followed == [6 * 6 + 2]
    for i in range(n):
        far = [v for k, v in levels(n, pairs, i).items() if k != i]
        assert close(near[i], len(far) / (n - 1) * len(far) / sum(far) if far else 0.0)
    for most in (20, 1):
        origins, k, _ = centrality.spread_sources(g, most)
        whole = inner(g, origins)
        found, by_levels = (column(centrality.betweenness(g, most, given), "betweenness") for given in (None, whole))
        assert all(close(found[i], by_levels[i]) for i in range(n)) and any(found.values())
        found, by_levels = (column(centrality.closeness(g, most, given), "closeness") for given in (None, whole))
        assert all(close(found[i], by_levels[i]) for i in range(n)) and any(found.values())


def test_only_rings_are_told_apart(spark, monkeypatch):
    """Without a ring of four no words are written; with some, only what lies on them."""
    written, inner = {}, centrality.staged

    def watched(df, name="state"):
        out = inner(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(centrality, "staged", watched)
    triangles = [(i, j) for k in range(0, 30, 3) for i, j in ((k, k + 1), (k + 1, k + 2), (k, k + 2))] + [(k, k + 5) for k in range(0, 25, 5)]
    hubs = [(40 + k, 30 + h) for k in range(12) for h in range(3)] + [(k, 30) for k in range(30)]
    for pairs, words in ((triangles, 0), (triangles + hubs, None)):
        near = {i: {b for p in pairs for a, b in (p, p[::-1]) if a == i} for i in range(60)}
        two = column(centrality.within_two_steps(graph(spark, 60, pairs)), "within_two")
        assert two == {i: len((near[i] | {y for x in near[i] for y in near[x]}) - {i}) for i in range(60)}
        assert words is None or written["near"] == words


def test_hubs_stay_where_they_lie(spark, monkeypatch):
    """Pieces with roots and hubs above a small limit: the same pieces, by lookups that are broadcast."""
    from tidegraph.functions import uneven

    monkeypatch.setattr(uneven, "MANY", 5)
    pairs = [(0, k) for k in range(3, 20)] + [(39, k) for k in range(20, 38)] + [(19, 39)] + [(k, k + 1) for k in range(40, 58)]
    g = graph(spark, 61, pairs)
    root = [0 if k < 40 and k not in (1, 2, 38) else 40 if 40 <= k < 59 else k for k in range(61)]
    assert column(components.connected_components(g), "lowest") == dict(enumerate(root))
    assert column(components.piece_sizes(components.connected_components(g), "lowest"), "piece_size") == {k: root.count(r) for k, r in enumerate(root)}
    order = sorted(set(root))
    assert column(components.numbered_components(g), "component") == {k: order.index(r) for k, r in enumerate(root)}
    assert column(components.reached_from(g, table(spark, [(7,), (60,)], "id bigint")), "reached") == {k: r in (0, 60) for k, r in enumerate(root)}


def test_cheapest_nodes_go_first(spark, monkeypatch):
    """More changed nodes than a round follows: the same routes, and steps are not shuffled once they lie."""
    monkeypatch.setattr(routes, "FRONT", 4)
    n, arcs = 40, random_pairs(91, 40, 160)
    both = [(a, b, w) for a, b, w in arcs if a != b and w] + [(b, a, w) for a, b, w in arcs if a != b and w]
    most, limits = {}, []
    for a, b, w in both:
        most[a, b] = max(w, most.get((a, b), 0))
    inner = routes._front

    def watched(labels, told):
        now, few = inner(labels, told)
        limits.append(labels.where(now).count() < labels.where("fresh").count())
        return now, few

    monkeypatch.setattr(routes, "_front", watched)
    found = {r["id"]: (r["cost"], r["source"], -1 if r["previous"] is None else r["previous"]) for r in routes.shortest_routes(graph(spark, n, arcs), [0, 7]).collect()}
    assert found == cheapest(n, [(a, b, w) for (a, b), w in most.items()], [0, 7]) and any(limits)


def test_rounds_of_routes_shuffle_nothing(spark, monkeypatch):
    """Labels lie in the same parts as the steps, so no round deals them out again; nothing stays in the catalog."""
    monkeypatch.setattr(routes, "PART", 20)
    arcs, plans, inner = random_pairs(92, 40, 160), [], routes.measured

    def watched(df, name, lying=None, **sums):
        if name == "labels":
            plans.append((lying.parts, df._jdf.queryExecution().executedPlan().toString()))
        return inner(df, name, lying, **sums)

    monkeypatch.setattr(routes, "measured", watched)
    most = {}
    for a, b, w in arcs:
        if a != b and w:
            most[a, b] = most[b, a] = max(w, most.get((a, b), 0))
    found = {r["id"]: (r["cost"], r["source"], -1 if r["previous"] is None else r["previous"]) for r in routes.shortest_routes(graph(spark, 40, arcs), [0, 7]).collect()}
    assert found == cheapest(40, [(a, b, w) for (a, b), w in most.items()], [0, 7])
    assert len(plans) > 2 and all(parts > 2 and "Exchange hashpartitioning" not in plan for parts, plan in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("labels", "steps"))]


def test_fine_parts_read_small_splits(spark, tmp_path):
    """A task of a round reads 16 MB of its files at most, however large they are; the setting is put back."""
    name = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(name), []
    edges = table(spark, [(1, 2), (2, 3)], "x bigint, y bigint")
    components.star_components(edges, lambda df: seen.append(spark.conf.get(name)) or rounds.staged(df)).collect()
    assert set(seen) == {"16m"} and spark.conf.get(name) == before
