"""What is asked: a graph, perhaps positions, and the nodes to go from and to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import AnyGraph, DiGraph, Duplicates, Graph
from ..operators.routes import node_table


@dataclass(frozen=True)
class PathQuery:
    """``positions`` has ``id, x, y, z``, one finite row for every node."""

    graph: AnyGraph
    positions: DataFrame | None = None
    sources: tuple[int, ...] = ()
    targets: tuple[int, ...] = ()

    @staticmethod
    def of(
        graph: AnyGraph, sources: Iterable[int] = (), targets: Iterable[int] = (), positions: DataFrame | None = None
    ) -> PathQuery:
        query = PathQuery(graph, positions, tuple(sorted(set(sources))), tuple(sorted(set(targets))))
        for role, nodes in (("source", query.sources), ("target", query.targets)):
            if nodes:
                wanted = node_table(graph.vertices.sparkSession, nodes)
                missing = wanted.join(graph.vertices, "id", "left_anti").take(1)
                if missing:
                    raise ValueError(f"{role} {missing[0][0]} is not a node of the graph")
        if positions is not None:
            bad = F.lit(False)
            for c in "xyz":
                bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            placed = graph.vertices.join(positions, "id", "left")
            odd = placed.where(bad).take(1)
            if odd:
                raise ValueError(f"node {odd[0][0]} has no finite position")
        return query

    @property
    def is_directed(self) -> bool:
        return isinstance(self.graph, DiGraph)

    @property
    def has_positions(self) -> bool:
        return self.positions is not None

    def node_count(self) -> int:
        return self.graph.node_count()

    def connections(self) -> DataFrame:
        """``src, dst, weight``: an undirected edge from its lower end, or every arc."""
        if isinstance(self.graph, DiGraph):
            return self.graph.arcs
        return self.graph.edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")

    def connection_count(self) -> int:
        return self.connections().count()

    def directed(self) -> DiGraph:
        return self.graph if isinstance(self.graph, DiGraph) else self.graph.directed()

    def undirected(self) -> tuple[Graph, bool]:
        """The graph without direction, an arc and its reverse keeping the larger
        weight, and whether direction was lost."""
        if isinstance(self.graph, DiGraph):
            return self.graph.undirected(Duplicates.KEEP_LARGEST), True
        return self.graph, False

    def ends(self) -> DataFrame:
        """The targets, or every node if there are none."""
        if self.targets:
            return node_table(self.graph.vertices.sparkSession, self.targets)
        return self.graph.vertices.select("id")

    def between(self, pairs: DataFrame, plan: bool = False) -> DataFrame:
        """``pairs(src, dst, ...)`` with ``apart``, their distance, in x and y only if ``plan``."""
        if self.positions is None:
            return pairs.withColumn("apart", F.lit(None).cast("double"))
        axes = "xy" if plan else "xyz"
        a = self.positions.select(F.col("id").alias("src"), *[F.col(c).alias(f"_a{c}") for c in axes])
        b = self.positions.select(F.col("id").alias("dst"), *[F.col(c).alias(f"_b{c}") for c in axes])
        square = " + ".join(f"pow(_a{c} - _b{c}, 2)" for c in axes)
        return pairs.join(a, "src").join(b, "dst").withColumn("apart", F.expr(f"sqrt({square})")).select(*pairs.columns, "apart")

    def with_ends(self, sources: Iterable[int], targets: Iterable[int]) -> PathQuery:
        return replace(self, sources=tuple(sorted(set(sources))), targets=tuple(sorted(set(targets))))

    def require_sources(self, method: str) -> None:
        if not self.sources:
            raise ValueError(f"{method} needs a source to start from")

    def require_targets(self, method: str, role: str) -> None:
        if not self.targets:
            raise ValueError(f"{method} needs a target: {role}")

    def require_one_to_one(self, method: str) -> None:
        if len(self.sources) != 1 or len(self.targets) != 1:
            raise ValueError(
                f"{method} goes from one source to one target, not from {len(self.sources)} to {len(self.targets)}"
            )

    def require_positions(self, method: str) -> None:
        if self.positions is None:
            raise ValueError(f"{method} needs the positions of the nodes")

    def require_directed(self, method: str, why: str) -> None:
        if not self.is_directed:
            raise ValueError(f"{method} needs a directed graph: {why}")
