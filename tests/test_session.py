"""Checkpoint-folder rules, and no switches on the size of the input."""

from pyspark.sql import functions as F

from drawseries.session import ensure_checkpoint_dir, store


def test_store_writes_to_the_shared_folder(spark):
    df = store(spark.range(10), "ten")
    assert df.count() == 10
    folder = ensure_checkpoint_dir(spark).split(":")[-1]
    assert all(folder in f for f in df.inputFiles())


def test_no_branch_on_row_or_partition_counts():
    import pathlib
    root = pathlib.Path(__file__).parent.parent / "drawseries"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            text = f.read_text()
            assert ".coalesce(1)" not in text and "getNumPartitions" not in text, f


def test_checkpoint_dir_is_shared_setting(spark):
    path = ensure_checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir() == path
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert df.checkpoint().count() == 10
