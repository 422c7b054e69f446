"""Range joins as equi-joins: boxes and points meet in the cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_side(boxes: DataFrame, low: list[str], high: list[str]) -> float:
    """The mean longest side of the boxes: large boxes then cover several cells."""
    side = F.greatest(*[F.col(b) - F.col(a) for a, b in zip(low, high)]) if len(low) > 1 else F.col(high[0]) - F.col(low[0])
    mean = boxes.agg(F.avg(side)).first()[0]
    return float(mean) if mean and mean > 0 else 1.0


def cell(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side))


def in_cells(boxes: DataFrame, low: list[str], high: list[str], side: float, prefix: str = "cell") -> DataFrame:
    """``boxes`` once for every cell they touch, with ``cell0``, ``cell1``, ..."""
    out = boxes
    for k, (a, b) in enumerate(zip(low, high)):
        out = out.withColumn(f"{prefix}{k}", F.explode(F.sequence(cell(F.col(a), side), cell(F.col(b), side))))
    return out


def along_cells(segments: DataFrame, start: list[str], end: list[str], side: float, prefix: str = "cell") -> DataFrame:
    """``segments`` once for every cell their line passes, in any number of dimensions.

    A segment is walked in slabs of cells across its longest direction; in each it
    covers the few cells between where it enters and where it leaves.  So a segment
    of L cells takes about L rows, not as many as its bounding box holds.  Cells
    that a line only touches may be listed as well.
    """
    axes = range(len(start))
    span = [F.col(b) - F.col(a) for a, b in zip(start, end)]
    longest = F.greatest(*[F.abs(d) for d in span]) if len(start) > 1 else F.abs(span[0])
    pad = F.lit(side * 1e-6)

    def major(values: list[Column]) -> Column:
        chosen = values[-1]
        for k in reversed(axes[:-1]):
            chosen = F.when(F.abs(span[k]) == longest, values[k]).otherwise(chosen)
        return chosen

    out = segments.withColumns({
        "_major": major([F.lit(k) for k in axes]), "_at": major([F.col(a) for a in start]), "_span": major(span),
    })
    low, high = F.least("_at", F.col("_at") + F.col("_span")), F.greatest("_at", F.col("_at") + F.col("_span"))
    out = out.withColumn("_slab", F.explode(F.sequence(cell(low - pad, side), cell(high + pad, side))))

    def when(edge: Column) -> Column:
        """How far along the segment it is at ``edge``, kept within it."""
        part = F.when(F.col("_span") != 0, (edge * side - F.col("_at")) / F.col("_span")).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))

    out = out.withColumns({"_in": when(F.col("_slab")), "_out": when(F.col("_slab") + 1)})
    for k in axes:
        entered, left = (F.col(start[k]) + F.col(t) * span[k] for t in ("_in", "_out"))
        across = F.sequence(cell(F.least(entered, left) - pad, side), cell(F.greatest(entered, left) + pad, side))
        out = out.withColumn(f"{prefix}{k}", F.explode(F.when(F.col("_major") == k, F.array("_slab")).otherwise(across)))
    return out.drop("_major", "_at", "_span", "_slab", "_in", "_out")
