"""Betweenness, closeness and neighbourhood counts of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.passing import passed
from ..functions.ranking import dense_index, running_before
from ..functions.uneven import looked_up
from ..graph import Graph
from ..plans.rounds import fine_parts, forget, staged, tidy
from .components import connected_components
from .trimming import Trimmed, trim

MAXIMUM_SOURCES = 2000
#: Nodes of a piece whose paths are followed inside one task, where every node is an origin.
SMALL = 64


def spread_sources(graph: Graph, maximum: int) -> tuple[DataFrame, int, int]:
    """``origin`` ids evenly spread over the sorted nodes, how many, and of how many."""
    if maximum < 1:
        raise ValueError("at least one source is needed")
    n = graph.node_count()
    k = min(n, maximum)
    if k == n:
        return graph.vertices.select(F.col("id").alias("origin")), n, n
    places = graph.vertices.sparkSession.range(k).select(F.expr(f"id * {n} div {k}").alias("index"))
    return dense_index(graph.vertices).join(places, "index").select(F.col("id").alias("origin")), k, n


def shortest_path_levels(graph: Graph, origins: DataFrame) -> list[DataFrame]:
    """For each number of steps, ``origin, node, paths``: how many shortest paths there are.

    All origins advance together.  A node next to level k lies in level k-1, k
    or k+1, so each round is compared with the last two levels only.
    """
    steps = staged(graph.both_ways().select("src", "dst"), "steps")
    levels = [staged(origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("paths")), "level")]
    while True:
        ahead = (
            levels[-1].join(steps, F.col("node") == F.col("src"))
            .groupBy("origin", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        )
        for back in levels[-2:]:
            ahead = ahead.join(back.select("origin", "node"), ["origin", "node"], "left_anti")
        ahead = staged(ahead, "level")
        if ahead.isEmpty():
            return levels
        levels.append(ahead)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def betweenness(
    graph: Graph, maximum_sources: int = MAXIMUM_SOURCES, levels: list[DataFrame] | None = None, trimmed: Trimmed | None = None
) -> DataFrame:
    """``id, betweenness``: the part of shortest paths between others that pass a node, 0 to 1.

    Exact up to ``maximum_sources`` nodes; beyond, estimated from that many
    sources spread evenly over the sorted ids.  Paths are counted in steps.
    Trees that hang from the graph are counted by the sizes of their branches; in the
    rest dependencies flow back level by level, each a join with the level above, and a
    node stands for all it carries.  ``levels`` of the whole graph, where they are known
    already, are followed as they are.  Where all nodes are origins, pieces of up to
    ``SMALL`` nodes are followed whole, many of them at a time.
    """
    origins, k, n = spread_sources(graph, maximum_sources)
    if n < 3:
        return graph.vertices.select("id", F.lit(0.0).alias("betweenness"))
    scale = 0.5 * n / k / ((n - 1) * (n - 2) / 2)
    if levels is not None:
        trimmed = Trimmed(graph, graph.vertices, ())
    trimmed = trimmed or trim(graph, origins)
    parts = []
    if trimmed.peeled:
        origins = staged(trimmed.loads.where("seeds > 0").select(F.col("id").alias("origin"), "seeds"), "origins")
        around = trimmed.handed_down(trimmed.totals()).join(trimmed.every_load(), "id")
        # Pairs of an origin and another node: in two branches, from a branch outwards, from outside into a branch.
        through = F.expr("(seeds - own) * (size - 1) - cross + (seeds - own) * (whole - size) + (asked - seeds) * (size - 1)")
        parts.append(around.select(F.col("id").alias("node"), through.cast("double").alias("owed")))
    if k == n and levels is None:
        owed, trimmed = _in_small_pieces(trimmed)
        parts.append(owed)
        origins = origins.join(trimmed.core.vertices.select(F.col("id").alias("origin")), "origin", "left_semi")
    parts += _dependencies(trimmed, origins, levels or shortest_path_levels(trimmed.core, origins))
    if not parts:
        return graph.vertices.select("id", F.lit(0.0).alias("betweenness"))
    total = _union(parts).groupBy(F.col("node").alias("id")).agg(F.sum("owed").alias("owed"))
    return graph.vertices.join(total, "id", "left").select(
        "id", F.coalesce(F.col("owed") * scale, F.lit(0.0)).alias("betweenness")
    )


def _in_small_pieces(trimmed: Trimmed) -> tuple[DataFrame, Trimmed]:
    """``node, owed`` of the core's pieces of up to ``SMALL`` nodes, and what is left without these."""
    core, pieces = trimmed.core, trimmed.pieces
    with fine_parts(core.vertices.sparkSession):
        sizes = pieces.groupBy("lowest").agg(F.count("*").alias("n"))
        placed = staged(looked_up(pieces, sizes, "lowest").select("id", "lowest", (F.col("n") <= SMALL).alias("small")), "placed")
        loads = trimmed.loads.select("id", "size", "seeds") if trimmed.peeled else core.vertices.select("id", F.lit(1).alias("size"), F.lit(1).alias("seeds"))
        ids = placed.where("small").select("id")
        near = core.edges.withColumnRenamed("a", "id").join(ids, "id", "left_semi").groupBy("id").agg(F.collect_list("b").alias("near"))
        few = placed.where("small").join(loads, "id").join(near, "id", "left").select(
            "lowest", F.struct("id", F.col("size").cast("bigint"), F.col("seeds").cast("bigint"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near")).alias("node")
        )
        owed = staged(few.groupBy("lowest").agg(F.collect_list("node").alias("nodes")).select("nodes").mapInArrow(passed, "node bigint, owed double"), "owed")
        large = staged(placed.where("not small").select("id"), "large")
        edges = staged(core.edges.join(large.withColumnRenamed("id", "a"), "a", "left_semi"), "edges")
    return owed, Trimmed(Graph(large, edges), trimmed.loads, trimmed.peeled)


def _dependencies(trimmed: Trimmed, origins: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """``node, owed`` of every level: what the origins' paths through the core owe to a node."""
    steps = trimmed.core.both_ways().select("src", "dst").withColumn("size", F.lit(1))
    if trimmed.peeled:
        steps = steps.drop("size").join(trimmed.loads.select(F.col("id").alias("src"), "size"), "src")
    steps = staged(steps, "steps")

    def summed(owed: DataFrame) -> DataFrame:
        if not trimmed.peeled:
            return owed.groupBy("node").agg(F.sum("owed").alias("owed"))
        return owed.join(origins, "origin").groupBy("node").agg(F.sum(F.col("owed") * F.col("seeds")).alias("owed"))

    owed = staged(levels[-1].withColumn("owed", F.lit(0.0)), "owed")
    sums = [summed(owed)] if len(levels) > 1 else []
    for level in reversed(levels[1:-1]):
        back = (
            owed.join(steps, F.col("node") == F.col("src"))
            .select("origin", F.col("dst").alias("node"), ((F.col("size") + F.col("owed")) / F.col("paths")).alias("part"))
            .groupBy("origin", "node").agg(F.sum("part").alias("part"))
        )
        owed = staged(
            level.join(back, ["origin", "node"], "left")
            .select("origin", "node", "paths", F.coalesce(F.col("paths") * F.col("part"), F.lit(0.0)).alias("owed")),
            "owed",
        )
        sums.append(summed(owed))
    return sums


def busiest(scores: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` nodes with betweenness above 0, highest first, ties by id."""
    return scores.where("betweenness > 0").orderBy(F.desc("betweenness"), "id").limit(top)


@tidy
def distance_sums(graph: Graph, origins: DataFrame) -> DataFrame:
    """``node, reached, total``: how many other origins a node is reached from, and their steps summed.

    Sixty-four origins are the bits of one number: a row is a node and one word of
    origins that have come to it, so that all origins advance together with a
    sixty-fourth of the rows.  Origins are numbered piece by piece, so that words are full
    however small the pieces are.  A round joins the words that are new with the edges,
    takes their union where they arrive and drops what had been there; when nothing is new
    in half of the words these are put aside, so that late rounds are small.  With a column
    ``seeds`` an origin counts so many times: a word has a mask for each of their digits.
    """
    with fine_parts(graph.vertices.sparkSession):
        return _word_sums(graph, origins)


def _word_sums(graph: Graph, origins: DataFrame) -> DataFrame:
    steps = staged(graph.both_ways().select("src", "dst"), "steps")
    pieces = connected_components(Graph(graph.vertices, steps.where("src < dst").toDF("a", "b")))
    placed = pieces.join(origins.select(F.col("origin").alias("id")), "id").withColumn("n", F.lit(1))
    numbered = staged(running_before(placed, "lowest", "id", name="index").select("id", "index"), "numbered")
    bit = F.expr("shiftleft(1L, int(index % 64))")
    zero = F.lit(0).cast("bigint")
    masks = None
    if "seeds" in origins.columns:
        digits = numbered.join(origins.withColumnRenamed("origin", "id"), "id").select(
            F.floor(F.col("index") / 64).alias("word"), bit.alias("bit"), F.explode(F.expr("filter(sequence(0, 62), d -> getbit(seeds, d) = 1)")).alias("digit")
        )
        masks = staged(
            digits.groupBy("word", "digit").agg(F.bit_or("bit").alias("mask"))
            .groupBy("word").agg(F.collect_list(F.struct(F.expr("shiftleft(1L, digit)").alias("times"), "mask")).alias("masks")),
            "masks",
        )
    now = staged(numbered.select(
        F.col("id").alias("node"), F.floor(F.col("index") / 64).alias("word"), bit.alias("seen"), bit.alias("fresh"),
        zero.alias("reached"), zero.alias("total"),
    ), "words")
    ended: list[DataFrame] = []
    far, words = 0, 0
    while True:
        live = now.where("fresh <> 0").select("word").distinct()
        k = live.count()
        if not k:
            break
        if 2 * k <= words:
            live = staged(live, "live")
            ended.append(staged(now.join(live, "word", "left_anti").select("node", "reached", "total"), "ended"))
            whole, now = now, staged(now.join(live, "word", "left_semi"), "words")
            forget(whole)
            words = k
        words = max(words, k)
        far += 1
        sent = now.where("fresh <> 0").join(steps, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), "word", zero.alias("seen"), F.col("fresh").alias("come"), zero.alias("reached"), zero.alias("total")
        )
        met = now.select("node", "word", "seen", zero.alias("come"), "reached", "total").union(sent).groupBy("node", "word").agg(
            F.bit_or("seen").alias("seen"), F.bit_or("come").alias("come"), F.sum("reached").alias("reached"), F.sum("total").alias("total")
        ).withColumn("fresh", F.expr("come & ~seen"))
        count = F.bit_count("fresh").cast("bigint")
        if masks is not None:
            met = met.join(masks, "word")
            count = F.expr("aggregate(masks, 0L, (n, m) -> n + m.times * bit_count(fresh & m.mask))")
        old, now = now, staged(met.select(
            "node", "word", F.col("seen").bitwiseOR(F.col("come")).alias("seen"), "fresh",
            (F.col("reached") + count).alias("reached"), (F.col("total") + far * count).alias("total"),
        ), "words")
        forget(old)
    counted = _union([now.select("node", "reached", "total"), *ended])
    return counted.groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total")).where("reached > 0")


def closeness(
    graph: Graph, maximum_sources: int = MAXIMUM_SOURCES, levels: list[DataFrame] | None = None, trimmed: Trimmed | None = None
) -> DataFrame:
    """``id, closeness``: nearness to what a node reaches, scaled by how much that is.

    ``levels``, where they are known already, are counted; otherwise origins are
    followed as bits of words where trees that hang from the graph have been taken off:
    a step into a tree is nearer to what it carries and farther from all else.
    """
    origins, k, n = spread_sources(graph, maximum_sources)
    if n < 2:
        return graph.vertices.select("id", F.lit(0.0).alias("closeness"))
    if levels is None:
        trimmed = trimmed or trim(graph, origins)
        sums = _trimmed_sums(trimmed) if trimmed.peeled else distance_sums(graph, origins)
    else:
        far = [f.groupBy("node").agg(F.count("*").alias("reached")).withColumn("steps", F.lit(d)) for d, f in enumerate(levels) if d]
        if not far:
            return graph.vertices.select("id", F.lit(0.0).alias("closeness"))
        sums = _union(far).groupBy("node").agg(
            F.sum("reached").alias("reached"), F.sum(F.col("reached") * F.col("steps")).alias("total")
        )
    # A node that is itself a source is not among its own others.
    own = origins.select(F.col("origin").alias("id"), F.lit(1).alias("own"))
    others = F.lit(k) - F.coalesce("own", F.lit(0)) if k < n else F.lit(k - 1)
    rows = graph.vertices.join(sums, F.col("id") == F.col("node"), "left").join(own, "id", "left")
    reached = F.col("reached").cast("double")
    value = (reached / others) * (reached / F.col("total"))
    return rows.select("id", F.when((F.col("total") > 0) & (others > 0), value).otherwise(0.0).alias("closeness"))


def _trimmed_sums(trimmed: Trimmed) -> DataFrame:
    """``distance_sums`` of a graph whose trees have been taken off, for all of its nodes."""
    seeds = trimmed.loads.where("seeds > 0").select(F.col("id").alias("origin"), "seeds")
    core = distance_sums(trimmed.core, seeds).select(F.col("node").alias("id"), "total")
    known = trimmed.totals().join(core, "id", "left").select("id", "asked", (F.coalesce("total", F.lit(0)) + F.col("depths")).alias("total"))
    every = trimmed.handed_down(known, total=F.expr("total + asked - 2 * seeds")).join(trimmed.every_load().select("id", "own"), "id")
    return every.select(F.col("id").alias("node"), F.expr("asked - own").alias("reached"), "total")


def _oriented(both: DataFrame) -> DataFrame:
    """``src, ka, dst, kb``: every edge from the end of lower degree (ties: lower id) to the other, with degrees."""
    degree = both.groupBy("src").agg(F.count("*").alias("k"))
    return (
        looked_up(looked_up(both, degree.withColumnRenamed("k", "ka"), "src"), degree.select(F.col("src").alias("dst"), F.col("k").alias("kb")), "dst")
        .where(F.struct("ka", "src") < F.struct("kb", "dst")).select("src", "ka", "dst", "kb")
    )


def triangles(graph: Graph) -> DataFrame:
    """``id, triangles``: the part of a node's pairs of neighbours that are neighbours.

    Edges point from the end of lower degree to the other, so a hub's pairs are
    never listed: a wedge starts at its lowest-degree corner.  Edges are read many times, so
    they are kept once, whatever they were made from.
    """
    with fine_parts(graph.vertices.sparkSession):
        both = staged(graph.both_ways().select("src", "dst"), "steps")
        degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
        closed = _closed(staged(_oriented(both), "oriented"))
        corners = closed.select(F.explode(F.array("src", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("closed"))
        counts = staged(degree.join(corners, "id", "left"), "counts")
    rows = graph.vertices.join(counts, "id", "left")
    k = F.col("k").cast("double")
    return rows.select(
        "id", F.when(k >= 2, 2 * F.coalesce("closed", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("triangles")
    )


def _closed(out: DataFrame) -> DataFrame:
    """``src, x, y``: every triangle once, from oriented edges."""
    left = out.select("src", F.col("dst").alias("x"), F.col("kb").alias("kx"))
    right = out.select("src", F.col("dst").alias("y"), F.col("kb").alias("ky"))
    wedge = left.join(right, "src").where(F.struct("kx", "x") < F.struct("ky", "y")).select("src", "x", "y")
    return wedge.join(out.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"]).select("src", "x", "y")


def _squared(out: DataFrame) -> DataFrame:
    """``src, dst``, both ways: the edges that lie on a ring of four.

    Such a ring has one highest corner x, by degree and id; it is found as two paths from x
    over a lower node to the same lower y.  So a hub's pairs are never listed.
    """
    high = out.select(F.col("src").alias("mid"), F.col("dst").alias("x"), F.col("kb").alias("kx"))
    ends = out.select(F.col("src").alias("mid"), F.col("dst").alias("y"), F.col("kb").alias("ky")).union(
        out.select("dst", "src", "ka")
    )
    paths = high.join(ends, "mid").where(F.struct("ky", "y") < F.struct("kx", "x")).select("mid", "x", "y")
    twice = staged(paths.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "twice")
    rings = paths.join(twice, ["x", "y"])
    found = rings.select(F.inline(F.array(
        F.struct(F.col("x").alias("src"), F.col("mid").alias("dst")), F.struct(F.col("mid").alias("src"), F.col("x").alias("dst")),
        F.struct(F.col("y").alias("src"), F.col("mid").alias("dst")), F.struct(F.col("mid").alias("src"), F.col("y").alias("dst")),
    )))
    return found.distinct()


def within_two_steps(graph: Graph) -> DataFrame:
    """``id, within_two``: how many other nodes lie one or two steps away.

    A node's neighbours and its neighbours' other neighbours are counted by degrees.  Counted
    too often are neighbours on a triangle with it, once, and nodes that share several
    neighbours with it, but once.  Of these all shared edges lie on rings of four; only
    there are nodes two steps away told apart, as bits, sixty-four to a word: a hub hands
    each of its neighbours its words and not its neighbours.
    """
    with fine_parts(graph.vertices.sparkSession):
        both = staged(graph.both_ways().where("src <> dst").select("src", "dst"), "steps")
        out = staged(_oriented(both), "oriented")
        ways = out.select(F.inline(F.array(
            F.struct(F.col("src").alias("id"), F.col("kb").alias("n")), F.struct(F.col("dst").alias("id"), F.col("ka").alias("n")),
        ))).groupBy("id").agg(F.sum("n").alias("n"))
        # An edge is a neighbour, and its other end's degree less one are those behind it.
        sides = F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a in ("src", "x", "y") for b in ("src", "x", "y") if a != b])
        beside = _closed(out).select(F.inline(sides)).distinct().groupBy("id").agg((-F.count("*")).alias("n"))
        rings = staged(_squared(out), "rings")
        degree = rings.groupBy("src").agg(F.count("*").alias("k"))
        again = looked_up(rings, degree.withColumnRenamed("src", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((-F.sum(F.col("k") - 1)).alias("n"))
        bits = dense_index(rings.select(F.col("src").alias("id")).distinct()).select(
            F.col("id").alias("dst"), F.floor(F.col("index") / 64).alias("word"), F.expr("shiftleft(1L, int(index % 64))").alias("bits")
        )
        near = staged(looked_up(rings, bits, "dst").groupBy("src", "word").agg(F.bit_or("bits").alias("bits")), "near")
        two = rings.join(near.withColumnRenamed("src", "dst"), "dst").groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
        # A node is two steps from itself.
        apart = two.groupBy(F.col("src").alias("id")).agg((F.sum(F.bit_count("bits")) - 1).alias("n"))
        counts = staged(ways.union(beside).union(again).union(apart).groupBy("id").agg(F.sum("n").alias("n")), "counts")
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("within_two"))
