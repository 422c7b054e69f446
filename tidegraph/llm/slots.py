"""Gapless ranks within groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salt

#: Rows that one sorted bucket of a group holds on average, at most.
BUCKET_ROWS = 20_000


def with_rank(df: DataFrame, group: str, name: str, rows: int, groups: int = 1) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within ``group``, in the fixed order of the column ``row``.

    ``df`` is narrow and staged, and ``row`` was made when it was written: a
    number of its own for every row, so that rows that repeat are dealt over the
    buckets like others.  A group is dealt over buckets of that number; rows are
    numbered inside a bucket and moved up by the sizes of the buckets before it.
    The number of buckets follows ``rows``, which a count of the input gives.  No
    task sees a whole group.
    """
    buckets = max(64, -(-rows // (BUCKET_ROWS * groups)))
    dealt = df.withColumn("_bucket", salt(F.col("row"), buckets))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("row")
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("bigint"))
        .drop("_bucket", "_row", "_start")
    )
