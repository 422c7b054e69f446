"""Joins on keys that may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is looked up where its rows lie.
MANY = 500_000


def frequent(rows: DataFrame, key: str) -> list:
    """Keys with more than ``MANY`` rows: few, one for so many rows."""
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > MANY).select(key).collect()]


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", often: list | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which holds a key once; no task gets all rows of a frequent key.

    What the table says of frequent keys is broadcast, and only the other rows are shuffled
    by their key.  ``often`` are those keys, where they are known already.
    """
    often = frequent(rows, key) if often is None else often
    if not often:
        return rows.join(table, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in often], rows.select(key).schema))
    held = F.broadcast(keys.join(table.join(keys, key, "left_semi"), key, how))
    return rows.join(held, key).unionByName(rows.join(keys, key, "left_anti").join(table, key, how))
