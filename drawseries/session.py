"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Configuration the library assumes.  UTC keeps DATE casts of timestamps
# identical on every executor and in the DuckDB oracle; AQE re-plans joins
# and coalesces small shuffle partitions at run time; skew-join splits a hot
# key across tasks.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles a method of more than 8,000 bytes: the feature windows' one
    # generated method would run interpreted, so Spark is to keep such stages in small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a window keeps a group's rows in memory up to this number and sorts them anew in spillable pages
    # beyond it: a block of the feature windows, with its halo and carried rows, is to stay under it
    "spark.sql.windowExec.buffer.in.memory.threshold": "20000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "drawseries", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's base configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read (a
    cluster without it is an error).  Only for a local master with the
    setting unset (tests, local runs) a fresh scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (checkpoints and "
                               "versioned tables must survive executor loss)")
        configured = tempfile.mkdtemp(prefix="drawseries-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))



def store_by(df, by: list[str], name: str):
    """Like :func:`store`, in folders by the columns ``by`` (the last of ``df``): a filter on them reads its
    folders only.  Every task writes its own rows, so no row is shuffled."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df, name: str):
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Like :func:`checkpoint`, but the planner then knows the table's size, so a
    join picks a broadcast by its own byte threshold before any shuffle is run.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
