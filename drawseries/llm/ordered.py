"""Dealing rows into blocks in the ascending order of a key, with the row after each block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Blocks per shuffle partition, and keys sampled for each block's bound.
BLOCKS_PER_PARTITION, KEYS_PER_BLOCK = 4, 20
LEAST = -(2 ** 63)


def block_bounds(df: DataFrame, key: str) -> np.ndarray:
    """Ascending first keys of blocks 1, 2, ...: quantiles of a sample of the keys.

    What reaches the driver is bounded by the number of shuffle partitions.
    """
    blocks = max(1, parts(df.sparkSession) * BLOCKS_PER_PARTITION)
    keys = df.select(df[key].cast("long").alias("k")).where("k is not null")
    n = keys.count()
    share = min(1.0, blocks * KEYS_PER_BLOCK / max(1, n))
    mark = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))
    got = np.sort([r.k for r in (keys.where(mark) if share < 1 else keys).distinct().collect()])
    if not len(got):
        return np.array([], dtype=np.int64)
    at = (np.arange(1, blocks) * len(got)) // blocks
    return np.unique(np.asarray(got, dtype=np.int64)[at])


def deal(df: DataFrame, key: str, bounds: np.ndarray) -> DataFrame:
    """``df`` with its block: keys from bounds[b - 1] to under bounds[b]; null keys are in block 0."""
    @F.pandas_udf("int")
    def block(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    return df.withColumn("block", block(F.coalesce(df[key].cast("long"), F.lit(LEAST))))


def sorted_blocks(df: DataFrame, n_blocks: int, *order: str) -> DataFrame:
    """Blocks in ascending order over the shuffle partitions, rows in order within each block."""
    n = max(1, min(parts(df.sparkSession), n_blocks))
    place = F.floor(F.col("block") * F.lit(n) / F.lit(n_blocks)).cast("int")
    return df.repartitionById(n, place).sortWithinPartitions("block", *order)
