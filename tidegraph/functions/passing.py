"""Shortest paths through the nodes of small pieces, many pieces at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Nodes by which pieces are padded to one width, and cells of the matrices of pieces that are in memory at once.
WIDTH, CELLS = 4, 1 << 17


def dependencies(near: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What all origins of each piece owe to each of its nodes (Brandes, 2001), pieces in the first axis.

    ``near`` tells which nodes are neighbours; a node stands for ``size`` of them and ``seeds`` origins.
    """
    front = np.broadcast_to(np.eye(near.shape[1]), near.shape)
    seen = front > 0
    fronts = []
    while front.any():
        fronts.append(front)
        front = np.where(seen, 0.0, front @ near)
        seen = seen | (front > 0)
    owed = np.zeros(near.shape)
    for k in range(len(fronts) - 1, 1, -1):
        part = np.divide(size[:, None, :] + owed, fronts[k], out=np.zeros(near.shape), where=fronts[k] > 0)
        owed = owed + part @ near * fronts[k - 1]
    return (seeds[:, None, :] @ owed)[:, 0]


def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, owed`` from pieces, each a list of its nodes: ``id, size, seeds`` and the neighbours named there."""
    for batch in batches:
        counts = batch.column(0).value_lengths().to_numpy().astype(np.int64)
        ids, size, seeds, near = batch.column(0).flatten().flatten()
        ids, size, seeds = (c.to_numpy() for c in (ids, size, seeds))
        here = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy())
        order = np.argsort(ids)
        there = order[np.searchsorted(ids, near.flatten().to_numpy(), sorter=order)]
        piece = np.repeat(np.arange(len(counts)), counts)
        local = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        owed = np.zeros(len(ids))
        widths = -(-counts // WIDTH) * WIDTH
        for width in np.unique(widths):
            alike = np.flatnonzero(widths == width)
            many = max(1, CELLS // width**2)
            for at in range(0, len(alike), many):
                chosen = alike[at : at + many]
                slot = np.full(len(counts), -1)
                slot[chosen] = np.arange(len(chosen))
                nodes, edges = slot[piece] >= 0, slot[piece[here]] >= 0
                place = (slot[piece[nodes]], local[nodes])
                tables = [np.zeros((len(chosen), width)) for _ in range(2)]
                for table, values in zip(tables, (size, seeds)):
                    table[place] = values[nodes]
                beside = np.zeros((len(chosen), width, width))
                a, b = here[edges], there[edges]
                beside[slot[piece[a]], local[a], local[b]] = 1
                beside[slot[piece[a]], local[b], local[a]] = 1
                owed[nodes] = dependencies(beside, *tables)[place]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(owed)], ["node", "owed"])
