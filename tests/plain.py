"""Small networks for tests, and plain answers to compare with."""

import heapq
import math

from tidegraph.graph import DiGraph, Duplicates, Graph


def table(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def graph(spark, n, pairs):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in pairs]
    return Graph.of(spark, n, table(spark, rows, "a bigint, b bigint, w double"))


def digraph(spark, n, arcs, duplicates=Duplicates.KEEP_SMALLEST):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in arcs]
    return DiGraph.of(spark, n, table(spark, rows, "a bigint, b bigint, w double"), duplicates)


def column(df, name, key="id"):
    return {r[key]: r[name] for r in df.collect()}


def cheapest(n, arcs, sources):
    """Cost, source and previous of each reached node, ties to lower ones."""
    best = {}
    queue = [(0.0, s, s, -1) for s in sources]
    out = {}
    for a, b, w in arcs:
        out.setdefault(a, []).append((b, w))
    heapq.heapify(queue)
    best = {s: (0.0, s, -1) for s in sources}
    done = set()
    while queue:
        c, s, x, _ = heapq.heappop(queue)
        if x in done:
            continue
        done.add(x)
        for y, w in out.get(x, []):
            label = (best[x][0] + w, best[x][1], x)
            if y not in best or label < best[y]:
                best[y] = label
                heapq.heappush(queue, (label[0], label[1], y, x))
    return best


def pieces(n, pairs, without=None):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in pairs:
        if without not in (a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def levels(n, pairs, start):
    near = {}
    for a, b, *_ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, front = {start: 0}, [start]
    while front:
        after = []
        for x in front:
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    after.append(y)
        front = after
    return far


def close(a, b, slack=1e-9):
    return math.isclose(a, b, rel_tol=slack, abs_tol=slack)
