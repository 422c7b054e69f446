"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rounds import staged

#: Narrow rows that one file of a round's state holds.
STATE_ROWS = 1_000_000


def kept(df: DataFrame, rows: int) -> DataFrame:
    """``df``, narrow rows of at most about ``rows``, written in few files and read back.

    For the state of rounds, which is small next to the texts.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
    return staged(df.coalesce(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_mark() -> Column:
    """A checksum of ``doc_id`` and ``text``: it tells rows of one id apart, and joins on one column."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat_ws(":", key, F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def salt(key: Column, buckets: int) -> Column:
    """A bucket in ``0..buckets-1`` that depends on ``key`` alone; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
