"""Shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .slots import with_rank


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    state = keys.astype(np.uint64)
    bucket = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        ahead[live] = ((bucket[live] + 1) * (2.0**31 / step)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """A column with the shard, 0 to ``shards - 1``, of a stable key column.

    Equal keys share a shard; a null key is a key like any other.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def assign(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().view(np.uint64), shards))

    return assign(F.xxhash64(key))


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` and ``shard``; write it with ``partitionBy("shard")``."""
    return docs.withColumn("shard", shard_of(F.col(key), shards))


def shard_index(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where every row goes: ``doc_id, size, text_crc32, shard, slot, grown_shard``.

    The law is ``key``: ``doc_id`` and the shard count decide, and one more
    shard takes rows only into itself (``grown_shard``).  ``size`` is the text's
    UTF-8 bytes plus 16.  Slots are gapless from 0 in each shard.

    Null text counts 0 bytes and has the checksum of the empty text; null
    ``doc_id`` is one key; repeated rows take a slot each; an empty table gives
    no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = staged(
        narrow.select(
            "*",
            shard_of(F.col("doc_id"), shards).alias("shard"),
            shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    ranked = with_rank(placed, "shard", "slot", placed.count(), shards)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
