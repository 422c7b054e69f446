"""What is answered: up to five tables, what they mean, and what is worth saying."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PathOutcome:
    """Tables that do not apply are None; a table and its name come together.

    ``routes(end, route)``, ``values(id, value)``,
    ``connection_values(src, dst, value)``, ``groups(group, id)`` and
    ``marked(rank, id)``.  A value is null where there is none.
    """

    method: str
    routes: DataFrame | None = None
    values: DataFrame | None = None
    values_name: str | None = None
    connection_values: DataFrame | None = None
    connection_values_name: str | None = None
    groups: DataFrame | None = None
    groups_name: str | None = None
    marked: DataFrame | None = None
    marked_name: str | None = None
    warnings: tuple[str, ...] = ()
    remarks: tuple[str, ...] = ()
    details: tuple[str, ...] = field(default=())
    rationale: str | None = None

    def reached_count(self) -> int:
        """How many routes reach their end."""
        return 0 if self.routes is None else self.routes.where(F.size("route") > 0).count()

    def check(self, vertices: DataFrame, connections: int) -> None:
        """Raises if a table does not fit the graph it is about."""
        n = vertices.count()
        named = {
            "values": (self.values, self.values_name, n),
            "connection values": (self.connection_values, self.connection_values_name, connections),
            "groups": (self.groups, self.groups_name, None),
            "marked nodes": (self.marked, self.marked_name, None),
        }
        for what, (table, name, rows) in named.items():
            if (table is None) != (name is None):
                raise RuntimeError(f"{self.method} gave {what} without a name, or a name without {what}")
            if table is not None and rows is not None and (found := table.count()) != rows:
                raise RuntimeError(f"{self.method} gave {found} {what} where there are {rows}")
        ids = [t.select("id") for t in (self.values, self.groups, self.marked) if t is not None]
        if self.routes is not None:
            ids.append(self.routes.select(F.col("end").alias("id")))
            ids.append(self.routes.select(F.explode("route").alias("id")))
        for table in ids:
            strange = table.join(vertices, "id", "left_anti").take(1)
            if strange:
                raise RuntimeError(f"{self.method} named {strange[0][0]}, which is not a node")

    def report(self) -> list[str]:
        """The run in words, a line for each fact."""
        head = self.method + (f", chosen because {self.rationale}" if self.rationale else "")
        lines = [head.rstrip(".") + ".", *self.details]
        if self.values is not None:
            lines.append(f"Each node has a value: {self.values_name}.")
        if self.connection_values is not None:
            lines.append(f"Each connection has a value: {self.connection_values_name}.")
        if self.groups is not None:
            n = self.groups.select("group").distinct().count()
            lines.append(f"There {'is' if n == 1 else 'are'} {counted(n, self.groups_name.lower())}.")
        if self.marked is not None:
            n = self.marked.count()
            lines.append(f"{counted(n, 'node').capitalize()} marked: {self.marked_name}.")
        return [*lines, *(f"Warning: {w}" for w in self.warnings), *self.remarks]


def counted(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def short(x: float) -> str:
    """At most three decimals, whatever the locale."""
    return f"{x:.3f}".rstrip("0").rstrip(".")
