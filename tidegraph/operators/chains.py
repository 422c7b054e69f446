"""Lists of nodes, each with at most one before it and one behind it, by random-mate contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import fine_parts, staged, tidy

#: Levels of contraction, and of expansion, that one write takes in.
LEVELS = 3
_LONG = "bigint"


def _none(kind: str = _LONG) -> Column:
    return F.lit(None).cast(kind)


def _contracted(rows: DataFrame) -> DataFrame:
    """``rows`` after one level: nodes whose hash is the least of the three around them go.

    About every third goes, and never two neighbours; the hash is of the id, so
    that nothing has to be fetched to decide.  What goes tells its neighbours of each
    other, and hands its weight to the one before.  Nobody gets more than two
    messages, so one sum by id does it, whatever the lists look like.  The level is a
    column, so that every round runs the same compiled code.
    """

    def mark(c: str) -> Column:
        return F.xxhash64(F.col(c), F.col("level"))

    own = F.col("gone").isNull()
    lone = (F.col("prev").isNull() & F.col("next").isNull()) | F.coalesce(F.col("prev") == F.col("id"), F.lit(False))
    least = [F.col(c).isNull() | (mark("id") < mark(c)) for c in ("prev", "next")]
    rows = rows.withColumn("goes", own & ~lone & least[0] & least[1])
    goes = F.col("goes")
    told = F.array_compact(F.array(
        F.struct(
            "id", "prev", "next", "first", "last", "low", "w", F.when(goes, F.col("level")).otherwise(F.col("gone")).alias("gone"), "level",
            _none().alias("prev2"), _none().alias("next2"), _none().alias("first2"), _none().alias("last2"),
            F.lit(0).alias("new_prev"), F.lit(0).alias("new_next"),
        ),
        F.when(goes & F.col("prev").isNotNull(), F.struct(
            F.col("prev").alias("id"), _none().alias("prev"), _none().alias("next"), _none().alias("first"), _none().alias("last"), "low", "w",
            _none("int").alias("gone"), "level", _none().alias("prev2"), F.col("next").alias("next2"), _none().alias("first2"), F.col("last").alias("last2"),
            F.lit(0).alias("new_prev"), F.lit(1).alias("new_next"),
        )),
        F.when(goes & F.col("next").isNotNull(), F.struct(
            F.col("next").alias("id"), _none().alias("prev"), _none().alias("next"), _none().alias("first"), _none().alias("last"), "low",
            F.lit(0).cast(_LONG).alias("w"), _none("int").alias("gone"), "level", F.col("prev").alias("prev2"), _none().alias("next2"),
            F.col("first").alias("first2"), _none().alias("last2"), F.lit(1).alias("new_prev"), F.lit(0).alias("new_next"),
        )),
    ))
    said = rows.select(F.inline(told)).groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("prev", "next", "first", "last", "gone", "prev2", "next2", "first2", "last2", "new_prev", "new_next")],
        F.min("low").alias("low"), F.sum("w").alias("w"), (F.max("level") + 1).alias("level"),
    )

    def now(c: str, new: str) -> Column:
        return F.when(F.col(new) == 1, F.col(c + "2")).otherwise(F.col(c)).alias(c)

    return said.select(
        "id", now("prev", "new_prev"), now("next", "new_next"), now("first", "new_prev"), now("last", "new_next"), "low", "w", "gone", "level"
    )


#: What is still to be contracted: it has a neighbour other than itself.
_MOVING = "gone is null and (prev is not null or next is not null) and not (prev <=> id)"


def _levels(links: DataFrame) -> list[DataFrame]:
    """The rows of ``links`` after every ``LEVELS`` levels of contraction, what was contracted before left out.

    Lists that have come down to one node stay where they are and are not carried on.
    """
    rows = staged(links.select(
        *[F.col(c).cast(_LONG).alias(c) for c in ("id", "prev", "next", "first", "last")], F.col("id").cast(_LONG).alias("low"),
        F.col("weight").cast(_LONG).alias("w"), _none("int").alias("gone"), F.lit(1).alias("level"),
    ), "lists")
    left = [rows]
    while not rows.where(_MOVING).isEmpty():
        step = rows.where(_MOVING)
        for _ in range(LEVELS):
            step = _contracted(step)
        rows = staged(step, "lists")
        left.append(rows)
    return left


def _ended(rows: DataFrame) -> DataFrame:
    """What lists and rings have come down to: one node each."""
    return rows.where(f"gone is null and not ({_MOVING})").select(
        "id", "first", "last", "low", F.col("prev").isNotNull().alias("ring"), F.when(F.col("prev").isNull(), F.col("w")).alias("rank")
    )


@tidy
def list_ends(links: DataFrame) -> DataFrame:
    """``first, last, ring`` once for every list or ring of ``links``, see ``ranked_lists``; no node is put back."""
    with fine_parts(links.sparkSession):
        return _union([_ended(rows) for rows in _levels(links)]).select("first", "last", "ring")


@tidy
def ranked_lists(links: DataFrame) -> DataFrame:
    """``id, first, last, low, ring, rank`` from ``id, prev, next, first, last, weight``.

    ``prev`` and ``next`` are neighbours among the ids, each other's; null where a
    list begins or ends, and there ``first`` and ``last`` hold what lies outside, if
    anything does.  Every node learns ``first`` and ``last`` of its list, its smallest id,
    whether it closes to a ring, and ``rank``: the weights from the node, its own
    included, to the end of the list (null on rings).

    A level leaves about two thirds of the nodes, so all levels together carry three
    times the nodes, lists and rings alike; then nodes are put back, last gone
    first, each by a join with one neighbour.
    """
    left = _levels(links)
    level = LEVELS * (len(left) - 1)
    found: list[DataFrame] = []
    for part in reversed(left):
        found.append(_ended(part))
        # What is put back hangs on nodes of later levels, which are all in ``found``.
        steps = []
        for _ in range(LEVELS if part is not left[0] else 0):
            near = part.where(F.col("gone") == level).select(
                "id", "next", "w", F.coalesce("next", "prev").alias("at")
            ).join(_union([*found, *steps]).withColumnRenamed("id", "at"), "at")
            steps.append(near.select(
                "id", "first", "last", "low", "ring",
                F.when(~F.col("ring"), F.col("w") + F.when(F.col("next").isNotNull(), F.col("rank")).otherwise(F.lit(0))).alias("rank"),
            ))
            level -= 1
        if steps:
            found.append(staged(_union(steps), "back"))
        if len(found) > 12:
            found = [staged(_union(found), "back")]
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out
