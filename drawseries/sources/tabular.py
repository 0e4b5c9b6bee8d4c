"""Draw tables in files: readers, incremental filters and snapshot writers.

Writers never overwrite the path they read: every write goes to a new
versioned folder (``<root>/v=<version>``) and readers take the newest one.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

from ..functions.clean import (ESSENTIAL, canonical_text, essential_columns, lottery_eq,
                               parse_fecha)

DRAW_SCHEMA = "fecha date, lottery string, result int, series string"
TEXT_SCHEMA = "fecha string, lottery string, result string, series string"


# -- S2 ---------------------------------------------------------------------

def read_draws(source, lottery: str | None = None, spark: SparkSession | None = None,
               canonical_names: bool = False) -> DataFrame:
    """All draws (of one lottery, case-insensitive) ordered by date.

    ``source`` is a DataFrame or a parquet path.  Tables written by this
    library store canonical (trimmed, upper-case) names; with
    ``canonical_names=True`` the case-insensitive match becomes an equality on
    the stored value, which Parquet evaluates in the scan (row-group and
    partition pruning) instead of after it.
    """
    df = source if isinstance(source, DataFrame) else spark.read.parquet(source)
    if lottery is not None:
        if canonical_names:
            df = df.filter(F.col("lottery") == lottery.strip().upper())
        else:
            df = df.filter(lottery_eq(lottery))
    df = df.select(F.col("fecha").cast("date").alias("fecha"), F.col("lottery").cast("string"),
                   F.col("result").cast("int"), F.col("series").cast("string"))
    return df.orderBy("fecha")


# -- S3 ---------------------------------------------------------------------

def read_draws_tabular(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: header-driven read; drop rows missing an essential field or failing a cast."""
    if fmt == "csv":
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE") \
            .schema(TEXT_SCHEMA).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    raw = essential_columns(raw)
    typed = raw.select(
        parse_fecha(F.col("fecha").cast("string")).alias("fecha"),
        canonical_text("lottery").alias("lottery"),
        F.expr("try_cast(trim(CAST(result AS STRING)) AS INT)").alias("result"),
        canonical_text("series").alias("series"),
    )
    return typed.dropna(subset=ESSENTIAL)


# -- S4 / S5 ----------------------------------------------------------------

def append_predictions(df: DataFrame, path: str, ts: _dt.datetime | None = None) -> None:
    """Append timestamped prediction records to a JSON log (new files only)."""
    stamp = F.lit(ts).cast("timestamp") if ts else F.current_timestamp()
    df.withColumn("timestamp", stamp).write.mode("append").json(path)


def write_batch(df: DataFrame, root: str, ts: _dt.datetime | None = None) -> str:
    """Batch predictions to a timestamped JSON folder partitioned by lottery."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc)
    path = f"{root}/batch_{ts:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").partitionBy("lottery").json(path)
    return path


# -- S6 ---------------------------------------------------------------------

def merge_snapshot(old: DataFrame, new: DataFrame, key=("fecha", "lottery"),
                   order_col: str = "k") -> DataFrame:
    """Concat, keep the last arrival per key (new after old, then ``order_col``).

    Duplicates of the key go on the first load too.
    """
    from ..operators.catalog import dedupe_last
    tagged = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return dedupe_last(tagged, list(key), ["_src", order_col]).drop("_src")


def write_version(df: DataFrame, root: str, version: int | str,
                  partition_by: tuple[str, ...] = ()) -> str:
    """Write a snapshot to a fresh versioned folder; never the folder being read.

    ``partition_by`` (e.g. ``("lottery",)``) lays files out by series so a
    filter on it prunes whole folders.
    """
    path = f"{root}/v={version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# -- S8 / S9 ----------------------------------------------------------------

def list_lotteries(df: DataFrame, col: str = "lottery") -> DataFrame:
    """Sorted distinct trimmed non-null names."""
    return df.select(F.trim(F.col(col)).alias(col)).dropna().distinct().orderBy(col)


def last_date(df: DataFrame, default_days_back: int | None = None,
              today: str | None = None, lotteries: DataFrame | None = None) -> DataFrame:
    """Last draw date per lottery; optional fallback start for empty history.

    ``default_days_back`` reproduces the file variant: with no history the
    start is ``today - days``.  ``lotteries`` names the series to report, with
    or without history (default: those that have some).
    """
    out = df.groupBy("lottery").agg(F.max("fecha").alias("last_fecha"))
    if lotteries is not None:
        out = lotteries.select("lottery").distinct().join(out, "lottery", "left")
    if default_days_back is not None:
        base = F.lit(today).cast("date") if today else F.current_date()
        out = out.withColumn("start_fecha", F.coalesce(
            F.date_add("last_fecha", 1), F.date_sub(base, default_days_back)))
    return out


# -- P4 ---------------------------------------------------------------------

def new_rows(feed: DataFrame, target: DataFrame, today: str, upper_bound: bool = False) -> DataFrame:
    """High-watermark increment per lottery.

    A lottery whose newest stored draw is on or after yesterday gets nothing;
    otherwise rows dated after its newest stored draw are kept (all rows when
    it has none).  ``upper_bound`` closes the range at yesterday (file
    variant).  The watermark table holds one row per lottery.
    """
    yesterday = F.date_sub(F.lit(today).cast("date"), 1)
    # written, so that the join need not shuffle the feed by its few lotteries
    marks = store(last_date(target).withColumnRenamed("lottery", "_lot"), "watermarks")
    j = feed.join(marks, feed["lottery"] == marks["_lot"], "left")
    keep = F.col("last_fecha").isNull() | (
        (F.col("last_fecha") < yesterday) & (F.col("fecha") >= F.date_add("last_fecha", 1)))
    if upper_bound:
        keep = keep & (F.col("fecha") <= yesterday)
    return j.filter(keep).drop("_lot", "last_fecha")


# -- versions ---------------------------------------------------------------

def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """Highest ``v=<n>`` folder under ``root`` (optionally ``n < below``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            n = int(name[2:])
            if below is None or n < below:
                found.append(n)
    return max(found) if found else None
