"""Running totals and dense numbers over sorted rows, in ranges instead of one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import staged


def running_before(rows: DataFrame, *keys: str, amount: str = "n", name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows before, in the order of ``keys``.

    Rows are dealt into ranges of the keys, which sampling makes even whatever the
    keys look like.  Totals are taken inside each range and moved up by those of
    the ranges before; only one total for each range meets in one window.  Rows
    with equal keys share a range, and the order among them is left open.
    """
    keys = keys or ("id",)
    dealt = staged(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(amount).alias("_total"))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, "_range")
        .withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint"))
        .drop("_range", "_own", "_start")
    )


def dense_index(ids: DataFrame) -> DataFrame:
    """``id, index``: 0, 1, 2, ... by ascending id; ids must be distinct."""
    return running_before(ids.select("id", F.lit(1).alias("n")), name="index").select("id", "index")
