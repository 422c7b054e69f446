"""Strongly connected components and levels of dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index, running_before
from ..graph import DiGraph
from ..plans.rounds import RoundLimit, fine_parts, forget, staged, tidy
from .chains import list_ends, ranked_lists

#: Trimming goes on while a round takes off one arc in so many; then chains are contracted anew.
TRIMS = 4


def _lowest_both_ways(arcs: DataFrame) -> DataFrame:
    """``id, f, b``: the smallest node that reaches each node, and the smallest it reaches.

    Both are spread in the same rounds, each one join and one minimum.
    """
    ways = staged(
        arcs.select("src", "dst", F.lit(True).alias("way")).union(arcs.select("dst", "src", F.lit(False))), "ways"
    )
    now = ways.select(F.col("src").alias("id"), "way").distinct()
    now = now.select("id", "way", F.col("id").alias("low"), F.lit(True).alias("fresh"))
    old = None
    while True:
        sent = now.where("fresh").withColumnRenamed("id", "src").join(ways, ["src", "way"]).select(
            F.col("dst").alias("id"), "way", "low", F.lit(None).cast("bigint").alias("old")
        )
        before, now = old, staged(
            now.select("id", "way", "low", F.col("low").alias("old")).union(sent)
            .groupBy("id", "way").agg(F.min("low").alias("low"), F.max("old").alias("old"))
            .select("id", "way", "low", (F.col("low") < F.col("old")).alias("fresh")),
            "lowest",
        )
        old = now
        if before is not None:
            forget(before)
        if now.where("fresh").isEmpty():
            break
    return now.groupBy("id").agg(
        F.max(F.when(F.col("way"), F.col("low"))).alias("f"), F.max(F.when(~F.col("way"), F.col("low"))).alias("b")
    )


def _trimmed(arcs: DataFrame) -> DataFrame:
    """``arcs`` without those at nodes that no arc enters or none leaves, again and again.

    Each round is two semi-joins of the arcs with their own ends and one write.
    """
    n = arcs.count()
    while n:
        old, arcs = arcs, _trimmed_once(arcs)
        forget(old)
        n, before = arcs.count(), n
        if n == before:
            break
    return arcs


def _trimmed_once(arcs: DataFrame) -> DataFrame:
    entered = arcs.select(F.col("dst").alias("src")).distinct()
    left = arcs.select(F.col("src").alias("dst")).distinct()
    return staged(arcs.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "arcs")


def _passed(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, prev, next`` of the nodes with one arc in and one out, and the same as lists: see ``ranked_lists``."""
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("prev"))
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"), F.min("dst").alias("next"))
    passed = staged(into.join(out, "id").where("n = 1 and m = 1").select("id", "prev", "next"), "passed")
    ids = passed.select("id")
    before, behind = ids.select(F.col("id").alias("prev"), F.lit(True).alias("p")), ids.select(F.col("id").alias("next"), F.lit(True).alias("q"))
    return passed, passed.join(before, "prev", "left").join(behind, "next", "left").select(
        "id", F.when(F.col("p"), F.col("prev")).alias("prev"), F.when(F.col("q"), F.col("next")).alias("next"),
        F.when(F.col("p").isNull(), F.col("prev")).alias("first"), F.when(F.col("q").isNull(), F.col("next")).alias("last"), F.lit(0).alias("weight"),
    )


def _without_chains(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``arcs`` between nodes that are not merely passed through, and what becomes of those that are.

    A node with one arc in and one out lies on a cycle just if the ends of its chain
    do.  Chains and rings of such nodes are contracted, three times the nodes in all.
    Returns the shorter arcs, ``id, prev, next`` of the nodes on chains, and ``id,
    lowest`` of those on rings.
    """
    passed, links = _passed(arcs)
    ids = passed.select("id")
    lists = ranked_lists(links)
    rings = lists.where("ring").select("id", F.col("low").alias("lowest"))
    chains = lists.where("not ring").select("id", F.col("first").alias("prev"), F.col("last").alias("next"))
    rest = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(chains.select(F.col("id").alias("dst"), "next"), "dst", "left")
    shorter = rest.select("src", F.coalesce("next", "dst").alias("dst")).where("src <> dst").distinct()
    return staged(shorter, "arcs"), chains, rings


@tidy
def strong_components(graph: DiGraph) -> DataFrame:
    """``id, lowest``: the smallest node of each node's strongly connected component.

    Nodes that are merely passed through are left out first and placed at the end.
    Of the others, nodes without arcs in or without arcs out are components of
    their own, and trimming leaves them out.  Where the smallest node that reaches
    a node is also the smallest it reaches, both are in one component, wholly found.
    Ends of an arc that differ in either are in different ones, so the arc goes, and
    what is left is trimmed and looked at anew.
    """
    arcs, chains, rings = _without_chains(staged(graph.arcs.select("src", "dst"), "arcs"))
    arcs = _trimmed(arcs)
    found: list[DataFrame] = [rings]
    while not arcs.isEmpty():
        lows = staged(_lowest_both_ways(arcs), "lows")
        found.append(lows.where("f = b").select("id", F.col("f").alias("lowest")))
        if len(found) > 16:
            found = [staged(_union(found), "found")]
        open_ = lows.where("f <> b")
        arcs = _trimmed(staged(
            arcs.join(open_.toDF("src", "f", "b"), "src").join(open_.toDF("dst", "f2", "b2"), "dst")
            .where("f = f2 and b = b2").select("src", "dst"),
            "arcs",
        ))
    known = staged(_union(found), "found")
    # A node on a chain belongs to the component of both its ends, if that is one.
    ends = chains.join(known.toDF("prev", "p"), "prev", "left").join(known.toDF("next", "q"), "next", "left").select(
        "id", F.coalesce("p", "prev").alias("p"), F.coalesce("q", "next").alias("q")
    )
    inside = ends.where("p = q").select("id", F.col("p").alias("lowest"))
    roots = inside.select(F.col("lowest").alias("id"), "lowest").distinct()  # an end may be alone but for its chain
    placed = staged(known.union(inside).union(roots).distinct(), "placed")
    names = placed.groupBy("lowest").agg(F.min("id").alias("name"))
    named = placed.join(names, "lowest").select("id", F.col("name").alias("lowest"))
    return graph.vertices.join(named, "id", "left").select("id", F.coalesce("lowest", "id").alias("lowest"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


@tidy
def heights(nodes: DataFrame, arcs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``id, height`` on an acyclic graph: the longest chain of arcs leaving each node.

    A node with one arc is as high as a step from what that leads to, or as what is
    known of it already; such steps compose, so chains of any length are jumped
    along in a logarithmic number of joins.  Nodes with several arcs then lead to
    ends, which settle those arcs, or to other nodes with several; so there are as
    many rounds as forks on a path, and not as nodes.
    """
    now = staged(nodes.select("id", F.lit(0).cast("bigint").alias("base")), "open")
    arcs = staged(arcs.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("bigint")), "arcs")
    known: list[DataFrame] = []
    waiting: list[DataFrame] = []
    while True:
        ways = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("next"), F.max("w").alias("add"))
        placed = staged(now.join(ways, "id", "left"), "placed")
        ends = placed.where("n is null").select("id", F.col("base").alias("height"))
        jumps = staged(placed.where("n = 1").select("id", "next", "add", "base"), "jumps")
        while True:
            on = jumps.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("add").alias("add2"), F.col("base").alias("base2"))
            moved = staged(jumps.join(on, "next", "left").select(
                "id", F.coalesce("next2", "next").alias("next"), (F.col("add") + F.coalesce("add2", F.lit(0))).alias("add"),
                F.greatest("base", F.col("add") + F.col("base2")).alias("base"), F.col("next2").isNotNull().alias("moved"),
            ), "jumps")
            forget(jumps)
            jumps = moved
            if moved.where("moved").isEmpty():
                break
        landed = staged(
            jumps.join(ends.toDF("next", "top"), "next", "left").withColumn("height", F.greatest("base", F.col("add") + F.col("top")))
            .select("id", "next", "add", "base", F.when(F.col("top").isNotNull(), F.col("height")).alias("height")),
            "landed",
        )
        settled = ends.union(landed.where("height is not null").select("id", "height"))
        known.append(settled)
        forks = placed.where("n > 1").select("id", "base")
        if forks.isEmpty():
            break
        if max_rounds is not None and len(known) >= max_rounds:
            raise RoundLimit(f"heights were still open after {len(known)} rounds")
        through = landed.where("height is null").select("id", "next", "add", "base")
        waiting.append(through)
        led = staged(
            arcs.join(forks.select(F.col("id").alias("src")), "src", "left_semi")
            .join(settled.toDF("dst", "height"), "dst", "left").join(through.withColumnRenamed("id", "dst"), "dst", "left")
            .select(
                "src", F.when(F.col("height").isNull(), F.coalesce("next", "dst")).alias("dst"),
                (F.col("w") + F.coalesce("add", F.lit(0))).alias("w"), F.greatest(F.col("w") + F.col("height"), F.col("w") + F.col("base")).alias("floor"),
            ),
            "led",
        )
        floors = led.groupBy(F.col("src").alias("id")).agg(F.max("floor").alias("floor"))
        now = staged(forks.join(floors, "id").select("id", F.greatest("base", "floor").alias("base")), "open")
        arcs = staged(led.where("dst is not null").groupBy("src", "dst").agg(F.max("w").alias("w")), "arcs")
    out = staged(_union(known), "heights")
    for through in reversed(waiting):
        more = through.join(out.toDF("next", "top"), "next").select("id", F.greatest("base", F.col("add") + F.col("top")).alias("height"))
        out = staged(out.union(more), "heights")
    return out


@tidy
def condensation(graph: DiGraph) -> DataFrame:
    """``id, component, height``; components are numbered by their lowest nodes.

    An arc means that its tail depends on its head, so heads lie lower.
    """
    placed = strong_components(graph)
    roots = placed.where("id = lowest").select("id")
    between = (
        graph.arcs.select("src", "dst").join(placed.toDF("src", "s"), "src").join(placed.toDF("dst", "d"), "dst")
        .where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    )
    high = heights(roots, between)
    numbers = dense_index(roots).toDF("lowest", "component")
    return (
        placed.join(numbers, "lowest").join(high.withColumnRenamed("id", "lowest"), "lowest")
        .select("id", "component", "height")
    )


def is_acyclic(condensed: DataFrame) -> bool:
    """Whether every component is a single node."""
    row = condensed.agg(F.count("*"), F.max("component")).first()
    return row[0] == (row[1] if row[1] is not None else -1) + 1


@tidy
def has_no_cycle(graph: DiGraph) -> bool:
    """``is_acyclic`` of the graph itself, for which nothing need be known of its components.

    Chains become one arc each; one that closes, or leads back to where it began, is a cycle.
    Of the rest, nodes that no arc enters or none leaves go; if there are arcs and
    all stay, there is a cycle among them.  Where few go, chains are contracted anew.
    """
    with fine_parts(graph.arcs.sparkSession):
        arcs = staged(graph.arcs.select("src", "dst"), "arcs")
        while True:
            passed, links = _passed(arcs)
            ends = list_ends(links)
            if not ends.where("ring or first = last").isEmpty():
                return False
            ids = passed.select("id")
            rest = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
            old, arcs = arcs, staged(rest.select("src", "dst").union(ends.select("first", "last")).distinct(), "arcs")
            forget(old, passed, ends)
            n = arcs.count()
            while n:
                old, arcs = arcs, _trimmed_once(arcs)
                forget(old)
                n, before = arcs.count(), n
                if n == before:
                    return False
                if n * TRIMS > before * (TRIMS - 1):
                    break
            if not n:
                return True


def topological_places(condensed: DataFrame) -> DataFrame:
    """``id, place``: 0, 1, ... in topological order."""
    return running_before(condensed.select("height", "id", F.lit(1).alias("n")), "height", "id", name="place").select("id", "place")


def topological_order(condensed: DataFrame) -> DataFrame:
    """Nodes by height and then id: what a node depends on comes before it."""
    return condensed.orderBy("height", "id")
