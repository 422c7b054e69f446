"""Exact nearest vectors by inner product, with pivot tables to skip candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIVOTS = 32
#: Vectors in one packed block of candidates, and of queries.
BLOCK = 2048
#: Candidates evaluated at once, in the order of their bounds.
STEP = 128
SCALE = 256

_PACKED = "block bigint, ids binary, n_queries int, width int, vectors binary, table binary"
_ASKED = "own_block bigint, own_row int, query_id bigint, width int, vector binary, near binary"
_QUERIES = "q_blocks binary, q_rows binary, q_ids binary, q_width int, q_vectors binary, q_near binary"
_FOUND_NAMES = ["q_block", "q_row", "query_id", "vec_id", "score"]
_FOUND = ", ".join(f"{n} bigint" for n in _FOUND_NAMES)
#: Vectors among which the pivots are chosen.
PIVOT_SAMPLE = 1024
#: Candidate blocks, and query blocks, that meet in one cell of the grid.
GROUP = 16


def quantise(vector: list[float | None] | None, scale: int = SCALE) -> np.ndarray | None:
    """``floor(scale * x)`` per component; None for null vectors or unusable components."""
    if vector is None or any(x is None for x in vector):
        return None
    whole = np.floor(np.asarray(vector, np.float64) * scale)
    return whole if np.isfinite(whole).all() else None


def choose_pivots(sample: list[np.ndarray], pivots: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those before."""
    if not sample:
        return np.zeros((1, 0))
    width = max(map(len, sample))
    rows = np.stack([np.pad(v, (0, width - len(v))) for v in sample])
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _widened(block: np.ndarray, width: int) -> np.ndarray:
    return np.pad(block, ((0, 0), (0, width - block.shape[1])))


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot; missing components are zeros."""
    width = max(vectors.shape[1], pivots.shape[1])
    a, b = _widened(vectors, width), _widened(pivots, width)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _packer(every: int, scale: int, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal count
            width = max(len(r) for r in rows)
            block = np.zeros((len(rows), width))
            for i, r in enumerate(rows):
                block[i, : len(r)] = r
            keys = np.array(ids, np.int64)
            count += 1
            ids.clear()
            rows.clear()
            cells = (
                ((part << 32) + count, pa.int64()),
                (keys.tobytes(), pa.binary()),
                (int((keys % every == 0).sum()), pa.int32()),
                (width, pa.int32()),
                (block.tobytes(), pa.binary()),
                (pivot_table(block, pivots).tobytes(), pa.binary()),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in cells],
                ["block", "ids", "n_queries", "width", "vectors", "table"],
            )

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = quantise(vector, scale) if key is not None else None
                if whole is None:
                    continue
                ids.append(key)
                rows.append(whole)
                if len(rows) == BLOCK:
                    yield packed()
        if rows:
            yield packed()

    return run


def block_top(
    queries: np.ndarray,
    near: np.ndarray,
    own: np.ndarray,
    vectors: np.ndarray,
    table: np.ndarray,
    keys: np.ndarray,
    k: int,
    floor: np.ndarray | None = None,
) -> list[tuple[int, int, int]]:
    """The ``k`` best ``(query row, key, score)`` of each query in one block.

    ``near`` and ``table`` hold the pivot distances of queries and candidates.
    Since ``2 q.x = |q|^2 + |x|^2 - |q-x|^2`` and ``|q-x| >= | |q-p| - |x-p| |``
    for every pivot p, they bound each score from above.  Candidates are
    evaluated in the order of their bounds, a step at a time, until the k-th
    best exceeds the next bound.  ``own[i]`` is the row to leave out, or -1.
    Scores below ``floor[i]``, where query ``i`` has as many elsewhere, may be left out.
    """
    norms, found = (vectors * vectors).sum(1), []
    for i, query in enumerate(queries):
        # A little slack keeps the bounds true in floating point.
        low = np.maximum(np.abs(table - near[i]).max(1) * (1 - 1e-9) - 1e-3, 0)
        square = query @ query + norms
        bounds = (square - low * low) / 2 + 1 + 1e-9 * square
        order = np.argsort(-bounds, kind="stable")
        order = order[order != own[i]]
        scores, at = np.empty(0), np.empty(0, np.int64)
        for a in range(0, len(order), STEP):
            if len(scores) >= k and scores[-1] > bounds[order[a]] or floor is not None and floor[i] > bounds[order[a]]:
                break
            step = order[a : a + STEP]
            scores = np.concatenate([scores, vectors[step] @ query])
            at = np.concatenate([at, step])
            best = np.lexsort((keys[at], -scores))[:k]
            scores, at = scores[best], at[best]
        found += [(i, int(keys[j]), int(s)) for j, s in zip(at, scores)]
    return found


def _best(rows: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row, row by row."""
    order = np.lexsort((keys, -scores, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _search(k: int, pivots: int):
    """The best of one cell of the grid: a block of queries takes what it has found on to the next candidates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in range(right.num_rows):
            row = right.slice(b, 1).to_pylist()[0]
            queries = np.frombuffer(row["q_vectors"]).reshape(-1, row["q_width"])
            near = np.frombuffer(row["q_near"]).reshape(-1, pivots)
            blocks, rows, q_keys = (np.frombuffer(row[c], np.int64) for c in ("q_blocks", "q_rows", "q_ids"))
            at, keys, scores = (np.empty(0, np.int64) for _ in range(3))
            floor = np.full(len(queries), -np.inf)
            for c in range(left.num_rows):
                held = {n: left.column(n)[c] for n in ("block", "width", "ids", "vectors", "table")}
                vectors = np.frombuffer(held["vectors"].as_buffer()).reshape(-1, held["width"].as_py())
                width = max(queries.shape[1], vectors.shape[1])
                top = block_top(
                    _widened(queries, width),
                    near,
                    np.where(blocks == held["block"].as_py(), rows, -1),
                    _widened(vectors, width),
                    np.frombuffer(held["table"].as_buffer()).reshape(-1, pivots),
                    np.frombuffer(held["ids"].as_buffer(), np.int64),
                    k,
                    floor,
                )
                at, keys, scores = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((at, keys, scores), zip(*top) if top else ((), (), ())))
                best = _best(at, keys, scores, k)
                at, keys, scores = at[best], keys[best], scores[best]
                last = np.searchsorted(at, np.arange(len(queries))) + k - 1
                full = np.bincount(at, minlength=len(queries)) == k
                floor[full] = scores[last[full]]
            cells = (blocks[at], rows[at], q_keys[at], keys, scores)
            out.append(pa.table([pa.array(x, pa.int64()) for x in cells], _FOUND_NAMES))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * len(_FOUND_NAMES), _FOUND_NAMES)

    return run


def _query_rows(every: int, pivots: int):
    """The queries of each block as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(keys % every == 0)
                vectors = np.frombuffer(row["vectors"]).reshape(-1, row["width"])
                near = np.frombuffer(row["table"]).reshape(-1, pivots)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(at), pa.int64()),
                        pa.array(at, pa.int32()),
                        pa.array(keys[at]),
                        pa.array([row["width"]] * len(at), pa.int32()),
                        pa.array([vectors[i].tobytes() for i in at], pa.binary()),
                        pa.array([near[i].tobytes() for i in at], pa.binary()),
                    ],
                    ["own_block", "own_row", "query_id", "width", "vector", "near"],
                )

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in blocks, as full as a partition has rows for."""

    def packed(rows: list[dict]) -> pa.RecordBatch:
        width = max(r["width"] for r in rows)
        vectors = np.stack([np.pad(np.frombuffer(r["vector"]), (0, width - r["width"])) for r in rows])
        cells = [np.array([r[c] for r in rows], np.int64).tobytes() for c in ("own_block", "own_row", "query_id")]
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array([c], pa.binary()) for c in cells],
                pa.array([width], pa.int32()),
                pa.array([vectors.tobytes()], pa.binary()),
                pa.array([b"".join(r["near"] for r in rows)], pa.binary()),
            ],
            ["q_blocks", "q_rows", "q_ids", "q_width", "q_vectors", "q_near"],
        )

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == BLOCK:
                yield packed(held)
                held = []
    if held:
        yield packed(held)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, pivots: int = PIVOTS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates
    are all rows but the query's own.  Ties go to the smaller ``vec_id``.
    Vectors are packed into blocks with their pivot distances where they are
    read, and queries once more into full blocks of their own.  The blocks of
    candidates and of queries are the sides of a grid: a candidate is copied once
    for each column, a query once for each row, and every pair of blocks meets in
    one cell, which leaves ``k`` rows a query.  A task gets both sides of a cell, and never
    the pairs of their blocks as rows; neither side is broadcast, though Spark takes the
    copies for no larger than what they are made from.

    Vectors that are null, or hold null or non-finite components, take no part,
    nor do rows with a null ``vec_id``.  Shorter vectors count as padded with
    zeros.  A repeated ``vec_id`` is another candidate; each of its rows is a
    query of its own, and all share the id in the result.  Scores are exact
    while products stay below 2**53.  An empty table gives no rows.  The pivots
    come from the first ``PIVOT_SAMPLE`` rows; they decide speed, not results.
    """
    read = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    seen = [quantise(r[1], scale) for r in read.limit(PIVOT_SAMPLE).collect()]
    centres = choose_pivots([v for v in seen if v is not None], pivots)
    packed = staged(read.mapInArrow(_packer(every, scale, centres), _PACKED), "vectors")
    size = packed.agg(F.sum("n_queries"), F.count("*")).first()
    n_queries, blocks = size[0] or 0, max(1, size[1])
    q_blocks = max(1, -(-n_queries // BLOCK))
    asked = staged(
        packed.where("n_queries > 0").mapInArrow(_query_rows(every, len(centres)), _ASKED)
        .repartition(q_blocks).mapInArrow(_gather, _QUERIES),
        "queries",
    )
    columns = -(-q_blocks // GROUP)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = max(-(-blocks // GROUP), min(blocks, 4 * cores))
    left = packed.select(
        "block", "ids", "width", "vectors", "table",
        F.pmod(F.xxhash64("block"), F.lit(rows)).alias("row"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))).alias("col"),
    )
    right = asked.select(
        "*",
        F.pmod(F.xxhash64("q_blocks", "q_rows"), F.lit(columns)).alias("col"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))).alias("row"),
    )
    found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_search(k, len(centres)), _FOUND)
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
