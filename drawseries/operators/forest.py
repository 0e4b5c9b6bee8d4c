"""Stored forests as one table: the models of any number of series score by one join (H3, H6, H7).

Every model folder of a registry is read at once; a model becomes one row that holds its
trees as arrays, indexed by node.  Rows to score meet their series' models in a join on the
series key, and each tree is walked inside the row, so neither the plan nor the number of
jobs grows with the series.  A series' rows are dealt into pieces of about ``PIECE`` rows, each of
which meets a copy of the models, so a long series is scored by many tasks.

Probabilities and predictions equal those of ``RandomForestClassificationModel``.  Defined
cases: a series without a registered model of a target has no row for it; a model of other
than ``n_features`` features raises where it is used; boosted models are not in the table.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import AtomicType

from ..session import shuffle_partitions, store
from .features import FEATURE_COLUMNS
from .model import TARGETS

# How MLlib stores a forest's nodes, and its class name.
NODES = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, "
         "gain:double, leftChild:int, rightChild:int, "
         "split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>")
FOREST = "RandomForestClassificationModel"
#: Rows that share a copy of their series' models.
PIECE = 4096


def _of_path(level: str) -> list:
    """Model id and label column from the path ``…/models/<model id>/<label>/<level>/<file>``."""
    found = F.col("_metadata.file_path")
    pattern = rf"/models/([^/]+)/([^/]+)/{level}/[^/]+$"
    return [F.regexp_extract(found, pattern, 1).alias("model_id"), F.regexp_extract(found, pattern, 2).alias("label")]


def forest_table(spark: SparkSession, root: str) -> DataFrame:
    """(model_id, label, depth, n_features, trees) of every forest stored under ``root/models``.

    ``trees`` is in the order of the forest; a tree is four arrays by node (feature, threshold,
    left, right; -1 for a leaf) and its leaves' class shares.
    """
    meta = spark.read.text(f"{root}/models/*/*/metadata/part-*").select(*_of_path("metadata"), "value")

    def param(name):
        return F.coalesce(F.get_json_object("value", f"$.paramMap.{name}"),
                          F.get_json_object("value", f"$.defaultParamMap.{name}")).cast("int")

    meta = meta.where(F.get_json_object("value", "$.class").endswith(FOREST)).select(
        "model_id", "label", param("maxDepth").alias("depth"),
        F.get_json_object("value", "$.numFeatures").cast("int").alias("n_features"))
    nodes = spark.read.schema(NODES).parquet(f"{root}/models/*/*/data").select(*_of_path("data"), "treeID", "nodeData.*")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    node = F.struct(
        "id", F.col("split.featureIndex").alias("feature"),
        F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(F.col("leftChild") < 0, F.transform("impurityStats", lambda x: F.when(total == 0, 0.0).otherwise(x / total)))
        .otherwise(F.array().cast("array<double>")).alias("share"))
    # a tree's nodes are numbered from 0 without gaps
    trees = (nodes.groupBy("model_id", "label", "treeID").agg(F.sort_array(F.collect_list(node)).alias("n"))
             .select("model_id", "label", F.struct("treeID", *[F.col(f"n.{c}").alias(c) for c in (
                 "feature", "threshold", "left", "right", "share")]).alias("tree")))
    whole = trees.groupBy("model_id", "label").agg(F.sort_array(F.collect_list("tree")).alias("trees"))
    return meta.join(whole, ["model_id", "label"])


def forests_of(registered: DataFrame, forests: DataFrame) -> DataFrame:
    """(lottery, label, …) for each registered row's target: four digits for a result, one sign for a series."""
    labels = F.when(F.col("target") == "series", F.array(F.lit("y_series"))).otherwise(
        F.array(*[F.lit(t) for t in TARGETS if t != "y_series"]))
    return registered.select("lottery", "model_id", F.explode(labels).alias("label")).join(forests, ["model_id", "label"])


def forest_scores(df: DataFrame, forests: DataFrame, n_features: int = len(FEATURE_COLUMNS), key: str = "lottery",
                  features: str = "features") -> DataFrame:
    """Every row of ``df`` once for each model of its series, with ``label``, ``prob`` and ``pred``."""
    guarded = F.when(F.col("n_features") == n_features, F.col("trees")).otherwise(
        F.raise_error(F.format_string("model %s of %s expects %d features", "model_id", "label", "n_features")))
    # a row a series, written so that the planner knows the (small) size
    sizes = store(df.groupBy(F.col(key).alias("_series")).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("_of")), "pieces")
    n_parts = shuffle_partitions(df.sparkSession)
    models = forests.select(F.col(key).alias("_series"), "label", F.col("depth").alias("_depth"), guarded.alias("_trees")) \
        .join(sizes, "_series").select("_series", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_piece"),
                                       "label", "_depth", "_trees").repartition(n_parts, "_series", "_piece")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    rows = df.withColumn("_x", vector_to_array(features)).join(sizes, F.col(key) == F.col("_series")) \
        .withColumn("_piece", F.pmod(F.xxhash64("_x", *plain), F.col("_of")).cast("int")).drop("_of")
    met = rows.repartition(n_parts, "_series", "_piece").join(models, ["_series", "_piece"])

    def leaf(tree):
        return F.aggregate(F.sequence(F.lit(0), F.col("_depth")), F.lit(0), lambda at, _: F.when(
            tree["left"][at] < 0, at).when(
            F.col("_x")[tree["feature"][at]] <= tree["threshold"][at], tree["left"][at]).otherwise(tree["right"][at]))

    met = met.withColumn("_shares", F.transform("_trees", lambda tree: tree["share"][leaf(tree)]))
    zeros = F.transform(F.get("_shares", F.lit(0)), lambda _: F.lit(0.0))
    votes = F.aggregate("_shares", zeros, lambda a, s: F.zip_with(a, s, lambda x, y: x + y))
    met = met.withColumn("_votes", votes)
    all_votes = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
    met = met.withColumn("prob", F.transform("_votes", lambda x: F.when(all_votes == 0, x).otherwise(x / all_votes)))
    pred = (F.array_position("prob", F.array_max("prob")) - 1).cast("double")
    return met.withColumn("pred", pred).drop(
        "_x", "_series", "_piece", "_depth", "_trees", "_shares", "_votes")


def wide_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """One row for each ``by`` with ``pred_*`` and ``prob_*`` of every target, as ``apply_models`` names them."""
    return scores.groupBy(*by).agg(*[
        F.max(F.when(F.col("label") == t, F.col(c))).alias(f"{c}_{t[2:]}") for t in TARGETS for c in ("pred", "prob")])
