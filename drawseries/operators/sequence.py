"""Distributed 1-based position of each row inside its series.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sorts a whole
series in one task: with few, long series (or one series holding a third of
all rows) that task is the job.  ``add_seq`` gives the same numbers with the
work spread over range partitions of ``(key, order...)``, which split even a
single hot series or hour:

1. rows are range partitioned and sorted, tagged with their partition and
   place, and written once (reliable checkpoint), so every later read sees the
   same boundaries and the source is read once;
2. rows are counted per ``(key, partition)`` and the counts prefix-summed per
   key into offsets: a table of at most ``partitions + keys`` rows, written
   too, so that the planner knows its size;
3. ``seq = offset + place in (key, partition)``.  The join attaches offsets by
   broadcast while their table is under Spark's own byte threshold and shuffles
   rows by ``(key, partition)``, which no hot key blocks, beyond it.

The order columns must make the order total (add a unique tie-breaker).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint, shuffle_partitions, store


def add_seq(df: DataFrame, key: str | list[str], order: list[str], name: str = "seq",
            partitions: int | None = None) -> DataFrame:
    """Row position per series (see module doc)."""
    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or shuffle_partitions(df.sparkSession)
    ordered = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    tagged = checkpoint(ordered.withColumn("_pid", F.spark_partition_id())
                        .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_p"), "_first",
                                  F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "seq-offsets")
    on = F.col("_pid") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return tagged.join(offsets, on).withColumn(
        name, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint")) \
        .drop("_pid", "_mid", "_p", "_first", "_off", *[f"_k_{k}" for k in keys])


#: The same function under the name of its method.
add_seq_range = add_seq


def add_seq_plain(df: DataFrame, key: str | list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Reference form (one sort per series); used as the test oracle."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
                         .cast("bigint"))
