"""Streaming ingest query (K1): its result must equal the batch upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.catalog import dedupe_last
from ..session import ensure_checkpoint_dir
from ..sources import testdata as td
from ..streaming.ingest import ingest_stream, start_table
from .q_catalog import OLD_SQL
from .registry import register

BATCHES = 3
FILES = 4               # of a batch


@register("ingest_stream", "lottery str, fecha date, result int, series str, k int", td.with_ctes(
    ["raw_old", "raw_new"], """
SELECT lottery, fecha, result, series, k FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY p DESC, k DESC) AS rn
  FROM (SELECT *, 0 AS p FROM old UNION ALL SELECT fecha, lottery, result, series, k, 1 AS p FROM raw_new) u) r
WHERE rn = 1""", [OLD_SQL]),
          note="new rows arrive as 3 files (range-partitioned on arrival) through a file stream")
def q_ingest_stream(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark)}/stream_{uuid.uuid4().hex}"
    new = td.raw_new(spark, sf_dir)
    # the feed: every new row, cut into files by arrival range
    new.repartitionByRange(BATCHES, "k").write.parquet(f"{root}/source")
    old = dedupe_last(td.raw_old(spark, sf_dir), ["fecha", "lottery"], ["k"])
    table = start_table(old, f"{root}/table", period="decade")
    out = ingest_stream(spark, f"{root}/source", new.schema, table, f"{root}/_checkpoint")
    return out.select("lottery", "fecha", "result", "series", F.col("k"))


@register("ingest_stream_events", "lottery str, fecha date, result int, ts str, event_id int", td.with_ctes(
    ["event_series"], """
SELECT lottery, fecha, result, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY ts DESC, event_id DESC) AS rn
  FROM event_series) r WHERE rn = 1"""),
          note="the events table arrives as 4 files; one row per (day, event type), newest arrival wins")
def q_ingest_stream_events(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark)}/stream_events_{uuid.uuid4().hex}"
    e = td.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("lottery"), F.col("ts").cast("date").alias("fecha"),
        (F.floor(F.col("value") * 100).cast("bigint") % 10000).cast("int").alias("result"),
        "ts", "event_id")
    # files hold arbitrary id ranges: a later file may carry earlier events (late data)
    e.repartition(4, F.xxhash64("event_id")).write.parquet(f"{root}/source")
    table = start_table(spark.createDataFrame([], e.schema), f"{root}/table", order="ts", period="month")
    out = ingest_stream(spark, f"{root}/source", e.schema, table, f"{root}/_checkpoint")
    return out.select("lottery", "fecha", "result",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id")


@register("ingest_stream_counts", "batches int, read int, inserted int, changed int, affected int, versions int", td.with_ctes(
    ["raw_old", "raw_new"], f"""
SELECT {BATCHES} AS batches, count(*) AS read, count(DISTINCT (n.fecha, n.lottery)) FILTER (o.k IS NULL) AS inserted,
       count(DISTINCT (n.fecha, n.lottery)) FILTER (o.k IS NOT NULL) AS changed, count(*) AS affected, {BATCHES} + 1 AS versions
FROM raw_new n LEFT JOIN old o ON n.fecha = o.fecha AND n.lottery = o.lottery""", [OLD_SQL]),
          note="four files a batch; batches hold days that no other has; counts are observed on the writes")
def q_ingest_stream_counts(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark)}/stream_counts_{uuid.uuid4().hex}"
    new = td.raw_new(spark, sf_dir)
    day = F.pmod(F.xxhash64("fecha"), F.lit(BATCHES)).cast("int")
    for i in range(BATCHES):
        new.where(day == i).repartition(FILES).write.mode("append").parquet(f"{root}/source")
    table = start_table(dedupe_last(td.raw_old(spark, sf_dir), ["fecha", "lottery"], ["k"]), f"{root}/table", period="decade")
    counts = []
    ingest_stream(spark, f"{root}/source", new.schema, table, f"{root}/_checkpoint", max_files_per_trigger=FILES, counts=counts)
    got = [len(counts), *[sum(c[w] for c in counts) for w in ("read", "inserted", "updated", "affected")], len(table.versions())]
    return spark.createDataFrame([got], "batches int, read long, inserted long, changed long, affected long, versions int")
