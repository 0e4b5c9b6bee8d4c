"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

#: Rows in one Arrow batch handed to a Python worker: texts may be very long,
#: so a batch is kept short to bound a worker's memory.
ARROW_ROWS = 512


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Memo(dict):
    """What ``make`` gives for a key, remembered for up to twice ``limit`` keys.

    Full, it becomes the older half and a new one begins, so that keys in use are
    kept.  Long keys are not remembered.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (see ``ARROW_ROWS``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage so that a lost executor cannot force a recomputation of
    everything before it, and gives the planner the table's real size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that the columns' text and the seed decide (52 bits of MD5).

    MD5 is used because every SQL engine computes it alike.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32(doc_id as text) mod n: the fold that decides what may be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def parts(spark: SparkSession) -> int:
    return shuffle_partitions(spark)


#: Bits of an id filter and the parts in which it is put together: 4 MB at any size of input.
FILTER_BITS, FILTER_SLICES = 1 << 25, 1024


def _place(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for b in batches:
        bits[_place(b.column(0).to_numpy(zero_copy_only=False))] = True
    parts = np.packbits(bits).reshape(FILTER_SLICES, -1)
    used = np.nonzero(parts.any(axis=1))[0]
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                                         names=["slice", "bits"])


def _joined_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = np.frombuffer(raw, np.uint8)
            sums[i] = sums[i] | got if i in sums else got
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "bits"])


def id_filter(ids: DataFrame, column: str):
    """A function of a long column: false only where the value is not among ``ids``.

    A bitmap of fixed size, so it may be sent to all tasks; it keeps rows that a join
    would drop out of the join's shuffle.  False positives are left to the join.
    """
    spark = ids.sparkSession
    table = np.zeros((FILTER_SLICES, FILTER_BITS // 8 // FILTER_SLICES), dtype=np.uint8)
    light = ids.select(ids[column].cast("long").alias("id")).where("id is not null")
    for r in (light.mapInArrow(_marks, "slice int, bits binary").repartition(parts(spark), "slice")
              .mapInArrow(_joined_marks, "slice int, bits binary").collect()):
        table[r.slice] |= np.frombuffer(bytes(r.bits), np.uint8)
    bits = table.reshape(-1)

    @F.pandas_udf("boolean")
    def maybe(v: pd.Series) -> pd.Series:
        at = _place(v.to_numpy())
        return pd.Series((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))
    return maybe
