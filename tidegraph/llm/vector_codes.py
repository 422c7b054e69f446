"""Product quantisation of vectors in whole numbers, with exponion search for the nearest entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The largest size of a component in whole numbers: sums of squares and of rows stay exact in 64 bits.
LARGEST = 2**24
#: Vectors of one start that are compared with as many of its neighbours.
BLOCK = 64
#: Groups of equal labels whose sums are small enough to be broadcast.
BROADCAST_ROWS = 1_000_000
#: Buckets over which the rows of a label are dealt beyond that.
SALTS = 64


def whole(vector: list[float | None] | None, scale: int = SCALE) -> list[int] | None:
    """``floor(scale * x)`` of every component; None for vectors that take no part.

    A finite component whose whole number is not below ``LARGEST`` in size cannot
    be counted with exactly and is an error.
    """
    if vector is None or any(x is None for x in vector):
        return None
    values = np.floor(np.asarray(vector, np.float64) * scale)
    if not np.isfinite(np.asarray(vector, np.float64)).all():
        return None
    if len(values) and not np.abs(values).max() < LARGEST:
        raise ValueError(f"components must stay below {LARGEST // scale} in size")
    return values.astype(np.int64).tolist()


def _whole_numbers(scale: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [whole(v, scale) for v in batch.column(1).to_pylist()]
            kept = pa.array([i for i, r in enumerate(rows) if r is not None], pa.int64())
            vectors = pa.array([np.asarray(r, np.int64).astype("<i4").tobytes() for r in rows if r is not None], pa.binary())
            sizes = pa.array([len(r) for r in rows if r is not None], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(2).take(kept), sizes, vectors], ["vec_id", "label", "size", "v"])

    return read


class Codebook:
    """The entries of one part, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = self.entries[:, None, :] - self.entries[None, :, :]
        square = (apart * apart).sum(2)
        self.near = np.argsort(square, axis=1, kind="stable")  # equal distances by index
        self.square = np.take_along_axis(square, self.near, 1)
        # Products of floats are exact as long as every sum of them is a whole number below 2**53.
        top = int(np.abs(self.entries).max(initial=0))
        self.top = max(top, 1)

    def nearest(self, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, ties to the lower index.

        An entry as near to a row as its start is lies within twice that distance of
        the start, so the start's neighbours are looked at up to there and no farther:
        four times the square, in whole numbers, bounds them without rounding.
        """
        best = np.empty(len(rows), np.int64)
        least = np.empty(len(rows), np.int64)
        own = rows - self.entries[start]
        reach = 4 * (own * own).sum(1)
        order = np.argsort(start, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(start[order]) != 0]) if len(order) else []
        for at, end in zip(begins, [*begins[1:], len(order)]):
            same = order[at:end]
            a = start[same[0]]
            far = np.searchsorted(self.square[a], reach[same], "right")
            by_far = np.argsort(far, kind="stable")
            for k in range(0, len(same), BLOCK):  # rows that look about equally far go together
                part = by_far[k : k + BLOCK]
                ids = self.near[a, : far[part[-1]]]
                found = self._distances(rows[same[part]], ids)
                low = found.min(1)
                best[same[part]] = np.where(found == low[:, None], ids, len(self.entries)).min(1)
                least[same[part]] = low
        return best, least

    def _distances(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        chosen = self.entries[ids]
        top = max(self.top, int(np.abs(rows).max(initial=0)))
        if rows.shape[1] * top * top * 4 < 2**53:
            product = (rows.astype(np.float64) @ chosen.T.astype(np.float64)).astype(np.int64)
        else:
            product = rows @ chosen.T
        return (rows * rows).sum(1)[:, None] - 2 * product + (chosen * chosen).sum(1)


def _moved(books: list[np.ndarray], last: bool):
    """Rows with the nearest entry of every part, found from the entry they had before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        width = books[0].shape[1]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, PARTS, width).astype(np.int64)
            before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
            code, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(ready):
                best, least = book.nearest(rows[:, p], before[:, p])
                code[:, p] = best
                error += least
            ids, labels = batch.column("vec_id"), batch.column("label")
            if last:
                text = pa.array([c.tobytes().hex() for c in code], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, labels, batch.column("v"), codes], ["vec_id", "label", "v", "code"])

    return assign


def _sums(width: int, entries: int):
    """Sums and counts of each part's entries over a task: one row for each entry in use."""
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, width), np.int64)
        count = np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(n, PARTS, width).astype(np.int64)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, PARTS)
            for p in range(PARTS):
                np.add.at(total[p], code[:, p], rows[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return add, "part int, entry int, n bigint" + "".join(f", {s} bigint" for s in names[3:])


def _starting_rows(vectors: DataFrame, entries: int) -> list[np.ndarray]:
    """The vectors of the smallest ids, nulls after all others and ties by the vector."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return [np.frombuffer(r["v"], "<i4").astype(np.int64) for r in first]


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over the rows of equal label, nulls together.

    Sums are made before anything is dealt.  Few labels go to every executor; many
    are met by rows that are dealt over buckets of their label, so that no task
    has all rows of one.
    """
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l"), "label_sums")
    if sums.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l"))).drop("l")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.select("l", "label_error", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("s"))
    return dealt.join(spread, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s", "salt")


def train_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` and the codebooks, after ``rounds`` rounds.

    A round is one pass over the packed vectors that assigns their parts, written
    with what they were assigned to, and one that sums them up by entry; only the
    sums of ``4 * entries`` entries reach the driver.
    """
    read = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label")
    )
    kind = read.schema["label"].dataType.simpleString()
    packed = read.mapInArrow(_whole_numbers(scale), f"vec_id bigint, label {kind}, size int, v binary")
    packed = staged(packed.where(f"size > 0 and size % {PARTS} = 0"), "vectors")
    lead = packed.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not lead:
        empty = packed.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty, [np.zeros((0, 0), np.int64)] * PARTS
    width = lead[0]["size"] // PARTS
    packed = packed.where(F.col("size") == lead[0]["size"]).drop("size")
    first = np.stack(_starting_rows(packed, entries)).reshape(-1, PARTS, width)
    books = [first[:, p].copy() for p in range(PARTS)]
    state = packed.withColumn("code", F.unhex(F.lit("00" * PARTS)))
    add, schema = _sums(width, len(first))
    sizes = ", ".join(f"sum(s{i})" for i in range(width))
    for _ in range(rounds):
        state = staged(state.mapInArrow(_moved(books, False), f"vec_id bigint, label {kind}, v binary, code binary"), "codes")
        sums = state.select("v", "code").mapInArrow(add, schema).groupBy("part", "entry").agg(
            F.expr("sum(n)").alias("n"), F.expr(f"array({sizes})").alias("total")
        ).collect()
        for r in sums:
            books[r["part"]][r["entry"]] = np.asarray(r["total"], np.int64) // r["n"]
    return state.mapInArrow(_moved(books, True), f"vec_id bigint, label {kind}, code string, error bigint"), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector.

    Null vectors and those with null or non-finite components are left out, and so
    are empty ones, ones that four does not divide, and ones of another length
    than the vector of the smallest id.  Components of 16384 and more in size are an
    error, not a guess.  A null ``vec_id`` comes after all others; repeated ids are rows
    like others, ties at the start go by the vector; with fewer vectors than
    entries there are as many entries as vectors; null labels are one label; an empty
    table gives no rows; other columns are not read.
    """
    coded, books = train_codes(vectors, entries, rounds, scale)
    rows = with_label_error(staged(coded, "coded"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
