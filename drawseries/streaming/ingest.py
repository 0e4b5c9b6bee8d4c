"""K1: incremental ingest as Structured Streaming.

A file source of raw draw rows feeds ``foreachBatch``; every micro-batch is merged
into a copy-on-write table (``sources.cow``) by the keyed upsert (A12 + J5): streamed
rows beat the rows the table started with, and among streamed rows the latest arrival
(``order`` column) wins.  Late rows are therefore accepted and need no watermark; the
outcome does not depend on how the input is cut into micro-batches.

A batch rewrites only the parts that its keys touch, so its cost follows the batch, not
the table.  A replayed batch is known by its number and changes nothing; one that died
before its commit is run again from the version it started from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.cow import CowTable


def start_table(initial: DataFrame, root: str, key=("fecha", "lottery"), order: str = "k", period: str = "year") -> CowTable:
    """Version 0 of the table: the stored rows, marked as not streamed."""
    table = CowTable(initial.sparkSession, root, key, order, period)
    table.start(initial)
    return table


def ingest_stream(spark: SparkSession, source_dir: str, schema, table: CowTable, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None, counts: list | None = None) -> DataFrame:
    """Run the stream until the source is drained (``availableNow``); the newest version's rows.

    ``counts`` takes what each batch's merge counted.
    """
    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        got = table.merge(batch, batch_id)
        if counts is not None and got is not None:
            counts.append({"batch": batch_id, **got})

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = reader.parquet(source_dir).writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint_dir) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()
