"""Metric alerts (L1) and alert queries (L2).

At most one alert per metric row, chosen by an ordered rule chain: a
critical F1 replaces any accuracy alert; a low-F1 warning is raised only when
accuracy raised nothing; a missing F1 is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default alert thresholds.
THRESHOLDS = {"accuracy_warning": 0.6, "accuracy_critical": 0.5,
              "f1_warning": 0.55, "f1_critical": 0.45}


def alerts(metrics: DataFrame, model_type: str = "model_type", accuracy: str = "accuracy",
           f1: str = "f1", thresholds: dict | None = None) -> DataFrame:
    """L1: metric rows → alert rows (rows without an alert are dropped)."""
    t = dict(THRESHOLDS, **(thresholds or {}))
    acc, f = F.col(accuracy), F.col(f1)
    rules = [
        (f.isNotNull() & (f < t["f1_critical"]), "CRITICAL", "f1", f, t["f1_critical"]),
        (acc < t["accuracy_critical"], "CRITICAL", "accuracy", acc, t["accuracy_critical"]),
        (acc < t["accuracy_warning"], "WARNING", "accuracy", acc, t["accuracy_warning"]),
        (f.isNotNull() & (f < t["f1_warning"]), "WARNING", "f1", f, t["f1_warning"]),
    ]

    def chain(i):
        cond, level, metric, value, thr = rules[i]
        alert = F.struct(F.lit(level).alias("level"),
                         F.concat(F.lit(metric + "_"), F.col(model_type)).alias("metric_name"),
                         value.cast("double").alias("value"), F.lit(thr).alias("threshold"))
        nxt = chain(i + 1) if i + 1 < len(rules) else F.lit(None)
        return F.when(cond, alert).otherwise(nxt)

    return metrics.withColumn("_a", chain(0)).filter(F.col("_a").isNotNull()) \
        .select(*[c for c in metrics.columns], "_a.*")


def recent(alerts_df: DataFrame, n: int = 10, ts: str = "ts", ties: tuple[str, ...] = ("k", "model_type")) -> DataFrame:
    """L2: the ``n`` latest alerts; equal times are told apart by ``ties``, greatest first."""
    return alerts_df.orderBy(*[F.col(c).desc() for c in (ts, *ties)]).limit(n)


def by_lottery(alerts_df: DataFrame, name: str) -> DataFrame:
    """L2: alerts of one lottery (exact match)."""
    return alerts_df.filter(F.col("lottery") == name)
