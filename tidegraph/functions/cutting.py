"""Cut vertices and bridges of small pieces, many pieces at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def cuts(starts: list[int], to: list[int], whole: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """How many nodes each node strands, and the bridges, by one walk in depth (Tarjan, 1972).

    ``to[starts[i]:starts[i + 1]]`` are the neighbours of node ``i``, ``whole[i]`` the nodes of its piece.
    """
    n, clock = len(whole), 0
    pre, low, up, size, apart, largest = [-1] * n, [0] * n, [-1] * n, [1] * n, [0] * n, [0] * n
    at, bridges = list(starts), []
    for root in range(n):
        if pre[root] >= 0:
            continue
        x = root
        pre[x] = low[x] = clock
        clock += 1
        while x >= 0:
            if at[x] < starts[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if pre[y] < 0:
                    up[y], pre[y], low[y] = x, clock, clock
                    clock += 1
                    x = y
                elif y != up[x] and pre[y] < low[x]:
                    low[x] = pre[y]
                continue
            p = up[x]
            if p >= 0:
                low[p] = min(low[p], low[x])
                size[p] += size[x]
                if low[x] >= pre[p]:
                    apart[p] += size[x]
                    largest[p] = max(largest[p], size[x])
                    if low[x] > pre[p]:
                        bridges.append((p, x))
            x = p
    return [w - 1 - max(most, w - 1 - s) if s else 0 for w, s, most in zip(whole, apart, largest)], bridges


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, stranded, across`` from pieces, each a list of its nodes: ``id`` and the neighbours named there.

    ``across`` are the higher ends of bridges whose lower end is ``id``.
    """
    for batch in batches:
        counts = batch.column(0).value_lengths().to_numpy().astype(np.int64)
        ids, near = batch.column(0).flatten().flatten()
        ids = ids.to_numpy()
        here = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy())
        order = np.argsort(ids)
        there = order[np.searchsorted(ids, near.flatten().to_numpy(), sorter=order)]
        src, dst = np.concatenate([here, there]), np.concatenate([there, here])
        by = np.argsort(src, kind="stable")
        starts = np.searchsorted(src[by], np.arange(len(ids) + 1))
        stranded, bridges = cuts(starts.tolist(), dst[by].tolist(), np.repeat(counts, counts).tolist())
        across: list[list[int]] = [[] for _ in ids]
        for a, b in bridges:
            a, b = (a, b) if ids[a] < ids[b] else (b, a)
            across[a].append(int(ids[b]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(stranded, pa.int64()), pa.array(across, pa.list_(pa.int64()))], ["id", "stranded", "across"]
        )
