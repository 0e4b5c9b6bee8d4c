"""Sharding by jump consistent hashing.

``shard = jump(xxhash64(key), n)``: no ring table, balanced to within sampling
noise, and going from n to n + 1 shards moves a row only into the new shard.
A row's slot is its gapless place in its shard.  Slots are dealt without a
per-shard window: rows are first merged into distinct (key, size, checksum)
entries with a count (map-side combine), entries are spread over hash blocks,
each block numbers its own entries, and blocks are offset by a prefix sum over
block totals.  No text is shuffled.

Defined cases: a null text has size 1 and checksum 0; null keys are one key,
"null"; rows that repeat get the same shard and different slots; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

SHARDS = 8
#: Hash blocks per shuffle partition; a block is the unit that numbers its rows.
BLOCKS_PER_PARTITION = 4

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into ``n`` shards, for a whole array."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    jumping = np.arange(len(state))
    nxt = np.zeros(len(state), dtype=np.int64)
    while len(jumping):
        shard[jumping] = nxt[jumping]
        with np.errstate(over="ignore"):
            state[jumping] = state[jumping] * _STEP + np.uint64(1)
        draw = (state[jumping] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[jumping] = ((shard[jumping] + 1) * (2147483648.0 / draw)).astype(np.int64)
        jumping = jumping[nxt[jumping] < n]
    return shard


def _jumps(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index("hash")).to_numpy(zero_copy_only=False)
            cols = list(b.columns) + [pa.array(jump(keys, n), pa.int32()), pa.array(jump(keys, n + 1), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "shard", "grown_shard"])
    return run


def shard_rows(df: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot), one row per input row."""
    k, t = df[key], df[text]
    light = df.select(
        k.alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(k.cast("string"), F.lit("null"))).alias("hash"))
    entries = light.groupBy("key", "size", "text_crc32", "hash").agg(F.count("*").alias("copies"))
    schema = entries.schema.simpleString()[7:-1].replace(":", " ")
    dealt = entries.mapInArrow(_jumps(n_shards), f"{schema}, shard int, grown_shard int")
    blocks = max(1, parts(df.sparkSession) * BLOCKS_PER_PARTITION)
    # bits of the hash beside those that decide the shard's first steps
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("hash", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("shard", "block").agg(F.sum("copies").alias("rows"))
               .select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("shard", "block").orderBy("hash", "key", "text_crc32", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (dealt.join(offsets, ["shard", "block"])
              .withColumn("first", F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))))
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"))
