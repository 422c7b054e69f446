"""Near-duplicate documents: MinHash, banding, verification, components.

The plan for N documents:

1. One pass over the texts gives each document the size and digest of its
   shingle set, band keys from ``ROWS`` universal hash minima a band and a
   small bit signature.  Equal sets collapse to one class here, by a
   pre-aggregated minimum, before anything is compared.
2. Every band bucket links its members to the bucket's smallest class (a star,
   so a bucket of m costs m rows).  Pairs that pass the bit signature are
   confirmed on full sets, and components are found.
3. Only buckets that still hold more than one component can hide further
   links.  The classes in them get a sharper signature of 1024 minima; the
   pairs of *different* components in a bucket that pass it are confirmed on
   full sets.  Components are then final.

The number of bands and what the signatures may differ in follow from the least
similarity.  A pair exactly at it meets in some band with probability 1 - 2.5e-7,
and both signature tests keep it with more than 1 - 1e-5.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from .common import kept, row_mark, staged
from .shingles import WIDTH, MinHasher, shingle_set

ROWS = 5
ROUGH, SHARP = 128, 1024
SIMILAR = (85, 100)

_SIGNED = (
    "doc_id bigint, mark binary, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>"
)


def layout(similar: tuple[int, int]) -> tuple[int, int, int]:
    """Bands, and how many of the rough and of the sharp minima may differ.

    At least the minima of the rough signature are made.  Of ``ROUGH`` two-bit
    and ``SHARP`` one-bit minima, six and 5.1 standard deviations beyond the
    mean at the least similarity may differ.
    """
    least = similar[0] / similar[1]
    bands = math.ceil(math.log(2.5e-7) / math.log1p(-(least**ROWS))) if least < 1 else 1

    def miss(n: int, differs: float, deviations: float) -> int:
        return math.ceil(n * differs + deviations * math.sqrt(n * differs * (1 - differs)))

    return max(bands, -(-ROUGH // ROWS)), miss(ROUGH, 0.75 * (1 - least), 6), miss(SHARP, 0.5 * (1 - least), 5.1)


def _planes(minima: np.ndarray, bit: int) -> list[int]:
    return np.packbits((minima >> np.uint32(bit)) & np.uint32(1)).view(np.int64).tolist()


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(width: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(ROWS * n_bands)
        spread = np.arange(n_bands, dtype=np.uint32)[:, None]
        for batch in batches:
            sizes, digests, bands, bits = [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None)
                    bands.append(None)
                    bits.append(None)
                    continue
                minima = hasher.minima(shingles)
                rows = np.hstack([minima.reshape(n_bands, ROWS), spread])
                digests.append(_digest(shingles))
                bands.append(
                    [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows]
                )
                bits.append(_planes(minima[:ROUGH], 0) + _planes(minima[:ROUGH], 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                ["doc_id", "mark", "n_shingles", "digest", "bands", "bits"],
            )

    return run


def _sets(width: int):
    """Full shingle sets and a 1024-bit signature, a row a batch as sets may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(SHARP, seed=11)
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingle_set(text, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node], pa.binary()),
                        pa.array([shingles.tobytes()], pa.binary()),
                        pa.array([_planes(hasher.minima(shingles), 0)], pa.list_(pa.int64())),
                    ],
                    ["node", "shingles", "sharp"],
                )

    return run


def _confirm(similar: tuple[int, int]):
    part, whole = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["u", "v"]
            ).filter(pa.array(keep, pa.bool_()))

    return run


def _total(terms: list) -> F.Column:
    return functools.reduce(operator.add, terms)


def _links(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return whole.mapInArrow(_confirm(similar), "u binary, v binary")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), row_mark().alias("mark"), F.col("text").cast("string").alias("text"))


def _placed(docs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """``doc_id, mark, n_shingles, first``: ``first`` is the smallest ``doc_id, mark`` of the group.

    It is null for rows without words, and for groups in which no row has an id.
    """
    bands, rough_miss, sharp_miss = layout(similar)
    signed = staged(_read(docs).mapInArrow(_sign(width, bands), _SIGNED), "signed")
    total = signed.count()
    # One class for equal sets.  It is known by its smallest id and digest, in this
    # order, as buckets link to the smallest: what was there first is like most copies.
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    rank = F.lpad(F.hex(F.coalesce(F.col("first.doc_id"), F.lit(2**63 - 1)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    reps = staged(
        signed.where("digest is not null").groupBy("digest").agg(
            F.min(row).alias("first"), F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "mark", F.col("n_shingles").alias("n"), "bands", "bits")).alias("sketch"),
        ).select(F.unhex(F.concat(rank, F.hex("digest"))).alias("node"), "digest", "first", "copies", "sketch.n", "sketch.bands", "sketch.bits", "sketch.mark"),
        "reps",
    )
    banded = reps.select("node", F.explode("bands").alias("key"))
    hubs = (
        banded.groupBy("key")
        .agg(F.min("node").alias("a"), F.max("node").alias("top"))
        .where("a < top")
        .select("key", "a")
    )
    shared = staged(banded.join(hubs, "key"), "shared")

    part, whole = similar
    sized = f"{whole} * least(na, nb) >= {part} * greatest(na, nb)"
    rough = _total(
        [
            F.bit_count(
                F.col("xa")[i].bitwiseXOR(F.col("xb")[i]).bitwiseOR(
                    F.col("xa")[i + 2].bitwiseXOR(F.col("xb")[i + 2])
                )
            )
            for i in range(2)
        ]
    )
    marks = reps.select("node", "n", "bits")
    stars = (
        shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()
        .join(marks.toDF("a", "na", "xa"), "a")
        .join(marks.toDF("b", "nb", "xb"), "b")
        .where(sized).where(rough <= rough_miss)
        .select("a", "b")
    )

    # Only texts that share a bucket are read again, one for each class.  They are
    # dealt by a merge join at every size, so that what is moved follows the input.
    near = shared.select("node").distinct().join(reps.select("node", "mark"), "node")
    texts = _read(docs).where("text is not null").select("mark", "text")
    chosen = texts.join(near.hint("merge"), "mark").groupBy("mark").agg(F.min("node").alias("node"), F.min("text").alias("text"))
    sets = staged(chosen.select("node", "text").mapInArrow(_sets(width), "node binary, shingles binary, sharp array<bigint>"), "sets")
    save = functools.partial(kept, rows=bands * total)
    found = star_components(_links(stars, sets, similar), save)

    # What the stars left open: buckets that still hold several components.
    comps = shared.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("comp")
    )
    mixed = (
        comps.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low < high").select("key")
    )
    detail = sets.select("node", "sharp").join(reps.select("node", "n", "bands"), "node")
    rows = staged(comps.join(mixed, "key").join(detail, "node"), "detail")
    names = ("node", "comp", "n", "sharp", "bands")
    left = rows.select("key", *(F.col(c).alias(f"{c}_a") for c in names))
    right = rows.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    sharp = _total(
        [
            F.bit_count(F.col("sharp_a")[i].bitwiseXOR(F.col("sharp_b")[i]))
            for i in range(SHARP // 64)
        ]
    )
    first_shared = F.expr(
        "bands_a[cast(array_position(zip_with(bands_a, bands_b, (x, y) -> x = y), true) as int) - 1]"
    )
    crossing = (
        left.join(right, "key")
        .where("node_a < node_b and comp_a <> comp_b")
        .where(f"{whole} * least(n_a, n_b) >= {part} * greatest(n_a, n_b)")
        .where(sharp <= sharp_miss)
        .where(F.col("key") == first_shared)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )
    more = _links(crossing, sets, similar)
    final = star_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), save)

    # Of the classes only those in larger groups, or with several rows, say more than a row itself does.
    grouped = final.join(reps.select("node", "digest", "first"), "node")
    firsts = grouped.groupBy("component").agg(F.min("first").alias("first"))
    linked = grouped.select("digest", "component").join(firsts, "component").select("digest", "first")
    alone = reps.where("copies > 1").select("node", "digest", "first").join(final.select("node"), "node", "left_anti")
    belongs = linked.union(alone.select("digest", "first")).withColumnRenamed("first", "_first")
    return (
        signed.select("doc_id", "mark", "n_shingles", "digest").join(belongs, "digest", "left")
        .select("doc_id", "mark", "n_shingles", F.when(F.col("digest").isNotNull(), F.coalesce("_first", row)).alias("first"))
    )


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Only ``doc_id`` and ``text`` are read; other columns may have any name.

    * null text, or one without words: no shingles, a component of its own;
    * fewer words than ``width``: one shingle, the whole sequence;
    * equal sets, repeated rows: one class, represented by its smallest id;
    * rows that repeat a ``doc_id`` are each placed by their own text;
    * null ``doc_id``: takes the component of rows in its group that have an id;
      where there is none, ``component_id`` is null and the row is kept;
    * empty table: no rows.

    ``similar`` is the least Jaccard similarity as a fraction; see ``layout``.
    """
    return (
        _placed(docs, width, similar)
        .select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def keep_one(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with its columns and one row for each group of near-duplicates.

    The row with the group's smallest id stays, of several texts with that id the
    one with the smallest checksum, and of rows that repeat both, one.  Documents
    without words have no group and stay, and so do groups in which no row has an
    id, whole; a row without an id goes if another of its group has one.
    """
    goes = F.coalesce(F.col("first") != F.struct("doc_id", "mark"), F.lit(False))
    verdicts = (
        _placed(docs, width, similar)
        .groupBy(F.col("mark").alias("_near_mark"))
        .agg(F.bool_or(goes).alias("_near_goes"), F.count("doc_id").alias("_near_rows"))
        .where("_near_goes or _near_rows > 1")
    )
    # One merge join at every size deals the texts once, by checksum.
    joined = docs.join(verdicts.hint("merge"), row_mark() == F.col("_near_mark"), "left")
    left = joined.where("_near_goes is null or not _near_goes")
    once = left.where("_near_rows is null").select(docs.columns)
    several = left.where("_near_rows > 1").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return once.union(several)
