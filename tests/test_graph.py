import random
from collections import defaultdict

import pytest
from plain import close, column, digraph, graph, table
from pyspark.sql import functions as F

from tidegraph.graph import DiGraph, Duplicates


def rows(df):
    return [tuple(r) for r in df.collect()]


def drawn(seed, n=14, m=60, weights=(0, 0.25, 1, 1.5, 4)):
    """Pairs with loops, repeats either way, and weights of nothing."""
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n), draw.choice(weights)) for _ in range(m)]


def undirected(pairs):
    best = {}
    for a, b, w in pairs:
        if a != b and w:
            key = (min(a, b), max(a, b))
            best[key] = max(w, best.get(key, w))
    return best


def test_undirected_rules(spark):
    pairs = drawn(31)
    edges = undirected(pairs)
    g = graph(spark, 16, pairs)
    assert rows(g.ordered_edges()) == [(a, b, float(w)) for (a, b), w in sorted(edges.items())]
    near = {x: sorted((b if a == x else a, float(w)) for (a, b), w in edges.items() if x in (a, b)) for x in range(16)}
    assert rows(g.neighbours(6)) == near[6]
    degree = column(g.degree(), "degree")
    assert set(degree) == set(range(16)) and all(close(degree[x], sum(w for _, w in near[x])) for x in range(16))
    assert (g.node_count(), g.edge_count()) == (16, len(edges))


@pytest.mark.parametrize("pair", [(6, 2, 1.0), (-1, 2, 1.0), (2, 4, -0.5), (1, 5, float("nan")), (5, 3, float("-inf"))])
def test_refused_edges(spark, pair):
    with pytest.raises(Exception, match="not allowed"):
        graph(spark, 6, [(0, 1, 1.0), pair]).edges.collect()


def test_no_nodes(spark):
    with pytest.raises(ValueError):
        graph(spark, 0, [(0, 0)])


@pytest.mark.parametrize("own", [0.0, 0.75])
def test_propagate(spark, own):
    pairs = drawn(32, n=9, m=20)
    edges, x = undirected(pairs), [1.5 * i - 4 for i in range(10)]
    weight = defaultdict(float)
    for (a, b), w in edges.items():
        weight[a, b] = weight[b, a] = w
    total = [own + sum(weight[i, j] for j in range(10)) for i in range(10)]
    scale = [t**-0.5 if t else 0.0 for t in total]
    wanted = [scale[i] * sum(((i == j) * own + weight[i, j]) * scale[j] * x[j] for j in range(10)) for i in range(10)]
    signal = table(spark, enumerate(x), "id bigint, x double")
    found = column(graph(spark, 10, pairs).propagate(signal, ["x"], own), "x")
    assert all(close(found[i], wanted[i]) for i in range(10))


def test_reweight(spark):
    g = graph(spark, 14, drawn(33))
    told = F.when((F.col("a") + F.col("b")) % 3 == 0, -1.0).otherwise(F.col("weight") / (1 + F.col("b")))
    wanted = [(a, b, w / (1 + b)) for a, b, w in rows(g.ordered_edges()) if (a + b) % 3]
    assert rows(g.reweight(told).ordered_edges()) == wanted
    for bad in (F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="not finite"):
            g.reweight(bad).edges.collect()
    with pytest.raises(ValueError):
        g.propagate(table(spark, [(0, 1.0)], "id bigint, x double"), ["x"], float("nan"))


@pytest.mark.parametrize("rule, fold", [(Duplicates.KEEP_SMALLEST, min), (Duplicates.KEEP_LARGEST, max), (Duplicates.SUM, sum)])
def test_directed(spark, rule, fold):
    pairs = drawn(34, weights=(-2, 0, 0.5, 3))
    every = defaultdict(list)
    for a, b, w in pairs:
        if a != b:
            every[a, b].append(w)
    arcs = [(a, b, float(fold(w))) for (a, b), w in sorted(every.items())]
    d = digraph(spark, 15, pairs, rule)
    assert rows(d.ordered_arcs()) == arcs and (d.node_count(), d.arc_count()) == (15, len(arcs))
    assert column(d.first_arcs(), "first_arc") == {x: sum(a < x for a, _, _ in arcs) for x in range(15)}
    assert sorted(rows(d.with_arc_ids()), key=lambda r: r[3]) == [(*arc, i) for i, arc in enumerate(arcs)]
    assert rows(d.predecessors(5)) == [(a, w, i) for i, (a, b, w) in enumerate(arcs) if b == 5]
    assert rows(d.successors(5)) == [(b, w) for a, b, w in arcs if a == 5]
    assert rows(d.weight(len(arcs) - 2)) == [(arcs[-2][2],)]
    with pytest.raises(ValueError):
        DiGraph.of(spark, 2, table(spark, [(0, 1, 1.0)], "a bigint, b bigint, w double"))


def test_unweighted_arcs_and_ids_that_are_hashes(spark):
    draw = random.Random(8)
    ids = [draw.randrange(-(2**62), 2**62) for _ in range(40)]
    pairs = [(draw.choice(ids[:3] + ids), draw.choice(ids)) for _ in range(150)]
    nodes = table(spark, [(i,) for i in ids], "id bigint")
    d = DiGraph.of(spark, nodes, table(spark, pairs, "a bigint, b bigint"))
    arcs = sorted({(a, b) for a, b in pairs if a != b})
    assert sorted((r[3], r[0], r[1]) for r in rows(d.with_arc_ids())) == [(i, a, b) for i, (a, b) in enumerate(arcs)]
    assert column(d.first_arcs(), "first_arc") == {x: sum(a < x for a, _ in arcs) for x in set(ids)}


def test_conversions(spark):
    g = graph(spark, 14, drawn(35))
    edges = {r[:2]: r[2] for r in rows(g.edges)}
    assert g.directed().arc_count() == 2 * len(edges)
    pairs = drawn(36, weights=(0.5, 2, 7))
    smallest = {}
    for a, b, w in pairs:
        if a != b:
            smallest[a, b] = min(w, smallest.get((a, b), w))
    folded = defaultdict(list)
    for (a, b), w in smallest.items():
        folded[min(a, b), max(a, b)].append(w)
    for rule, fold in ((Duplicates.KEEP_SMALLEST, min), (Duplicates.SUM, sum)):
        assert rows(digraph(spark, 14, pairs).undirected(rule).ordered_edges()) == [(a, b, float(fold(w))) for (a, b), w in sorted(folded.items())]
    asked = [(b, a) for a, b in list(edges)[:4]] + [(x, x) for x in range(3)]
    found = {r[:2]: r[2] for r in rows(g.weight_of(table(spark, asked, "src bigint, dst bigint")))}
    assert found == {(a, b): edges.get((min(a, b), max(a, b))) for a, b in asked}
    with pytest.raises(Exception, match="not allowed"):
        digraph(spark, 3, [(2, 1, -1.5)]).undirected(Duplicates.SUM).edges.collect()
