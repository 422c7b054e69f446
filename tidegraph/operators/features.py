"""A table of readings for every node."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.rounds import staged
from .centrality import betweenness, closeness, shortest_path_levels, spread_sources, triangles, within_two_steps
from .components import connected_components, piece_sizes
from .cuts import cut_structure
from .routes import breadth_first, shortest_routes
from .trimming import trim

#: Names of the readings, in their order.
FEATURES = (
    "Connections", "Strength", "Triangles", "Within Two Steps", "Betweenness",
    "Closeness", "Stranded", "Piece Size", "Steps To Source", "Cost To Source",
)


@dataclass(frozen=True)
class NodeFeatures:
    """``table`` with ``id`` and a column for each of ``FEATURES``, and remarks on it."""

    table: DataFrame
    remarks: tuple[str, ...]


def node_features(
    graph: Graph, sources: Iterable[int] = (), maximum_sources: int = sys.maxsize, readings: Iterable[str] = FEATURES
) -> NodeFeatures:
    """Every reading of every node, or those of ``readings``; distances are -1 where no source is reached.

    Betweenness and closeness follow paths from every node; whoever gives fewer
    ``maximum_sources`` asks for estimates from that many.  Betweenness and closeness share
    the graph without its trees or, where it has few, one run of breadth-first levels.
    Rounds run as soon as they are asked for, so readings that nobody reads are not taken.
    """
    sources, wanted = sorted(set(sources)), set(readings)
    if wanted - set(FEATURES):
        raise ValueError(f"no such readings: {sorted(wanted - set(FEATURES))}")
    graph = Graph(staged(graph.vertices, "vertices"), staged(graph.edges, "edges"))  # read many times
    parts, remarks = [graph.vertices], []
    if wanted & {"Connections", "Strength"}:
        counts = graph.both_ways().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        parts.append(graph.vertices.join(counts, "id", "left").select(
            "id", F.coalesce("n", F.lit(0)).cast("double").alias("Connections"), F.coalesce("w", F.lit(0.0)).alias("Strength")
        ))
    if "Triangles" in wanted:
        parts.append(triangles(graph).withColumnRenamed("triangles", "Triangles"))
    if "Within Two Steps" in wanted:
        parts.append(within_two_steps(graph).select("id", F.col("within_two").cast("double").alias("Within Two Steps")))
    paths, estimate = wanted & {"Betweenness", "Closeness"}, None
    if paths:
        origins, k, n = spread_sources(graph, maximum_sources)
        origins = staged(origins, "origins")
        trimmed = trim(graph, origins)
        levels = None if trimmed.peeled else shortest_path_levels(graph, origins)
        if "Betweenness" in paths:
            parts.append(betweenness(graph, maximum_sources, levels, trimmed).withColumnRenamed("betweenness", "Betweenness"))
        if "Closeness" in paths:
            parts.append(closeness(graph, maximum_sources, levels, trimmed).withColumnRenamed("closeness", "Closeness"))
        if k < n:
            estimate = f"{' and '.join(sorted(paths))} are estimated from {k} of {n} nodes."
    pieces = staged(connected_components(graph), "pieces") if wanted & {"Stranded", "Piece Size"} else None
    if "Stranded" in wanted:
        parts.append(cut_structure(graph, pieces=pieces)[0].select("id", F.col("stranded").cast("double").alias("Stranded")))
    if "Piece Size" in wanted:
        parts.append(piece_sizes(pieces, "lowest").select("id", F.col("piece_size").cast("double").alias("Piece Size")))
    away = wanted & {"Steps To Source", "Cost To Source"}
    if away and sources:
        found = {}
        if "Steps To Source" in away:
            found["Steps To Source"] = breadth_first(graph, sources).select("id", F.col("steps").cast("double").alias("Steps To Source"))
        if "Cost To Source" in away:
            found["Cost To Source"] = shortest_routes(graph, sources).select("id", F.col("cost").alias("Cost To Source"))
        far = graph.vertices
        for frame in found.values():
            far = far.join(frame, "id", "left")
        far = staged(far, "far")
        unreached = far.where(F.col(next(iter(found))).isNull()).count()
        if unreached:
            remarks.append(f"{unreached} nodes cannot be reached from a source; their distances are -1.")
        parts.append(far.select("id", *[F.coalesce(name, F.lit(-1.0)).alias(name) for name in found]))
    elif away:
        remarks.append("No sources were given; the distances to a source are -1.")
        parts.append(graph.vertices.select("id", *[F.lit(-1.0).alias(name) for name in away]))
    if estimate:
        remarks.append(estimate)
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, "id")
    return NodeFeatures(table.select("id", *[name for name in FEATURES if name in wanted]), tuple(remarks))
