"""Model registry (H5): metadata table in versioned Parquet folders plus MLlib
model folders.  Two slots per (lottery, target): a free slot is taken, else
the worst is replaced only by a strictly better model (T7)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import FEATURE_COLUMNS
from .training import keep_two_slots

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("lottery", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("algorithm", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("n_features", T.IntegerType()), T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("n_records", T.LongType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("model_path", T.StringType()), T.StructField("k", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """Newest registry version, or an empty table."""
    from ..sources.tabular import latest_version
    v = latest_version(spark, root)
    if v is None:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/v={v}")


def entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Registry rows for freshly trained models (driver-side metadata)."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    out = []
    for i, r in enumerate(rows):
        out.append((r.get("model_id") or uuid.uuid4().hex, r["lottery"], r["target"], r.get("algorithm", "rf"),
                    r.get("accuracy"), r.get("f1"), len(FEATURE_COLUMNS), list(FEATURE_COLUMNS),
                    r.get("n_records"), {k: str(v) for k, v in (r.get("params") or {}).items()},
                    r.get("model_path"), int(r.get("k", i)), r.get("ts", now)))
    return spark.createDataFrame(out, REGISTRY_SCHEMA)


def register_if_better(spark: SparkSession, root: str, new: DataFrame, models: dict | None = None,
                       slots: int = 2) -> tuple[DataFrame, str]:
    """H5: merge new entries into the registry keeping ``slots`` per
    (lottery, target); saves the MLlib models that made it (``models``: for
    (lottery, target, model_id) the fitted models by label column); writes a new
    registry version and returns (kept entries, version path)."""
    current = read_registry(spark, root)
    start = current.agg(F.coalesce(F.max("k"), F.lit(-1))).collect()[0][0] + 1
    new = new.withColumn("k", F.col("k") + F.lit(start))
    merged = keep_two_slots(current.unionByName(new), slots=slots).drop("slot")
    kept_ids = {r[0] for r in merged.select("model_id").collect()}
    to_save = [(mid, t, m) for (_lot, _t, mid), parts in (models or {}).items() if mid in kept_ids
               for t, m in parts.items()]
    # each save is a small Spark job; run them side by side
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=8) as pool:
        list(pool.map(lambda x: x[2].write().overwrite().save(f"{root}/models/{x[0]}/{x[1]}"), to_save))
    merged = merged.withColumn("model_path", F.when(
        F.col("model_path").isNull(), F.concat(F.lit(f"{root}/models/"), F.col("model_id")))
        .otherwise(F.col("model_path")))
    version = int(_dt.datetime.now().timestamp() * 1000)
    path = f"{root}/v={version}"
    merged.write.mode("errorifexists").parquet(path)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path), path


def load_models(entry) -> dict:
    """The fitted models of one registry row, by label column.

    Raises ``ValueError`` if the row's features are not the present ones.
    """
    from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel

    from .model import DIGITS
    if list(entry["feature_names"]) != list(FEATURE_COLUMNS):
        raise ValueError(f"model {entry['model_id']} was trained on other features")
    kind = RandomForestClassificationModel if entry["algorithm"] == "rf" else OneVsRestModel
    labels = ["y_series"] if entry["target"] == "series" else [f"y_{d}" for d in DIGITS]
    return {t: kind.load(f"{entry['model_path']}/{t}") for t in labels}


def best_models(spark: SparkSession, root: str, lotteries: list[str]) -> tuple[dict, dict]:
    """T6 then load: ({lottery: models of all targets}, {lottery: status}).

    A lottery without a registered model of both targets gets the status
    ``no_model`` and is left out.
    """
    from .training import best_model
    rows: dict[str, dict] = {}
    for r in best_model(read_registry(spark, root)).where(F.col("lottery").isin(*lotteries)).collect():
        rows.setdefault(r["lottery"], {})[r["target"]] = r
    models, status = {}, {}
    for lot in lotteries:
        found = rows.get(lot, {})
        if {"result", "series"} <= found.keys():
            models[lot] = {**load_models(found["result"]), **load_models(found["series"])}
        status[lot] = "ok" if lot in models else "no_model"
    return models, status
