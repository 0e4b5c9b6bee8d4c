"""Feature queries (W1–W42) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import DOUBLE_FEATURES, FEATURE_COLUMNS, features
from ..sources import testdata as td
from .registry import register

FEATURE_SPEC = ", ".join(f"{c} {'dbl' if c in DOUBLE_FEATURES else 'int'}" for c in FEATURE_COLUMNS)
KEY_SPEC = "lottery str, seq int, fecha date, result int"


def features_sql(source: str) -> tuple[list[str], str]:
    """Oracle text for the 41 columns over CTE ``source`` (lottery, seq, fecha, result)."""
    W = "PARTITION BY lottery ORDER BY seq"
    WR = "PARTITION BY lottery, result ORDER BY seq"

    def rows(lo, hi):
        lo_t = f"{-lo} PRECEDING" if lo < 0 else "CURRENT ROW"
        hi_t = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
        return f"({W} ROWS BETWEEN {lo_t} AND {hi_t})"

    def dig(x, p):
        return f"CAST(CAST(floor(({x}) / {p}) AS BIGINT) % 10 AS BIGINT)"

    f0 = f"""f0 AS (
  SELECT lottery, seq, fecha, result,
    {', '.join(f'lag(result, {k}) OVER ({W}) AS l{k}' for k in (1, 2, 3, 5, 7))},
    avg(result) OVER {rows(-6, 0)} AS m7, stddev_samp(result) OVER {rows(-6, 0)} AS s7,
    avg(result) OVER {rows(-29, 0)} AS m30, stddev_samp(result) OVER {rows(-29, 0)} AS s30,
    max(result) OVER {rows(-6, 0)} AS mx7, min(result) OVER {rows(-6, 0)} AS mn7,
    avg(result) OVER {rows(-7, -1)} AS pm7, avg(result) OVER {rows(-30, -1)} AS pm30,
    stddev_samp(result) OVER {rows(-30, -1)} AS ps30,
    first_value(result) OVER {rows(-6, 0)} AS fv7, first_value(result) OVER {rows(-29, 0)} AS fv30,
    {', '.join(f'count(*) OVER ({WR} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) AS freq_{n}' for n in (10, 30, 90))},
    lag(fecha) OVER ({WR}) AS prev_fecha
  FROM {source})"""
    f1 = "f1 AS (SELECT *, coalesce(sign(result - l1), 0) AS s FROM f0)"
    f2 = f"""f2 AS (SELECT *, CASE WHEN lag(s) OVER ({W}) IS NULL OR s <> lag(s) OVER ({W}) THEN seq END AS cp FROM f1)"""
    f3 = f"""f3 AS (SELECT *, max(cp) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st,
              coalesce(l1, 0) AS v1 FROM f2)"""
    cols = {
        "result_lag_1": "l1", "result_lag_2": "l2", "result_lag_3": "l3",
        "result_lag_5": "l5", "result_lag_7": "l7",
    }
    for k in (1, 2, 3):
        for name, p in zip(("miles", "centenas", "decenas", "unidades"), (1000, 100, 10, 1)):
            cols[f"lag{k}_{name}"] = dig(f"coalesce(l{k}, 0)", p)
    suma = " + ".join(dig("v1", p) for p in (1000, 100, 10, 1))
    cols.update({
        "diff_1": "result - l1", "diff_2": "l1 - l2", "diff_abs_1": "abs(result - l1)",
        "signo_diff_1": "sign(result - l1)", "racha": "s * (seq - st + 1)",
        "rolling_mean_7": "m7", "rolling_std_7": "s7", "rolling_mean_30": "m30",
        "rolling_std_30": "s30", "rolling_max_7": "mx7", "rolling_min_7": "mn7",
        "rolling_range_7": "mx7 - mn7",
        "lag1_sobre_media_7": "CASE WHEN v1 > coalesce(pm7, 0) THEN 1 ELSE 0 END",
        "lag1_sobre_media_30": "CASE WHEN v1 > coalesce(pm30, 0) THEN 1 ELSE 0 END",
        "lag1_z_score_30": "(v1 - coalesce(pm30, 0)) / (CASE WHEN ps30 IS NULL OR ps30 = 0 THEN 1.0 ELSE ps30 END)",
        "tendencia_7": "CASE WHEN l1 IS NOT NULL AND result > fv7 THEN 1 ELSE 0 END",
        "tendencia_30": "CASE WHEN l1 IS NOT NULL AND result > fv30 THEN 1 ELSE 0 END",
        "lag1_suma_digitos": suma,
        "lag1_suma_digitos_par": f"CASE WHEN ({suma}) % 2 = 0 THEN 1 ELSE 0 END",
        "lag1_unidades_par": "CASE WHEN v1 % 10 % 2 = 0 THEN 1 ELSE 0 END",
        "freq_10": "freq_10", "freq_30": "freq_30", "freq_90": "freq_90",
        "dias_desde_ultimo": "date_diff('day', prev_fecha, fecha)",
    })
    sel = ",\n  ".join(
        f"coalesce(CAST({cols[c]} AS {'DOUBLE' if c in DOUBLE_FEATURES else 'BIGINT'}), 0) AS {c}"
        for c in FEATURE_COLUMNS)
    body = f"SELECT lottery, seq, fecha, result,\n  {sel}\nFROM f3"
    return [f0, f1, f2, f3], body


def _draw_features_sql():
    extra, body = features_sql("draws")
    return td.with_ctes(["draws"], body, extra)


@register("features_recorded", f"{KEY_SPEC}, {FEATURE_SPEC}", _draw_features_sql())
def q_features_recorded(spark, sf_dir):
    """W1–W41 over F1 draws, block + halo form with the default blocks."""
    return features(td.draws(spark, sf_dir))


@register("features_blocked", f"{KEY_SPEC}, {FEATURE_SPEC}", _draw_features_sql())
def q_features_blocked(spark, sf_dir):
    """W1–W41 over F1 draws, block + halo form (B=256 rows, several blocks per series)."""
    return features(td.draws(spark, sf_dir), block_rows=256)


def _event_features_sql():
    extra, body = features_sql("event_series")
    return td.with_ctes(["event_series"], body, extra)


@register("features_events_blocked", f"{KEY_SPEC}, {FEATURE_SPEC}", _event_features_sql())
def q_features_events_blocked(spark, sf_dir):
    """W1–W41 over the long event series (F4), block + halo form."""
    return features(td.event_series(spark, sf_dir), block_rows=1024)


def _line_features_sql():
    extra, body = features_sql("line_series")
    return td.with_ctes(["line_series"], body, extra)


@register("features_single_series_blocked", f"{KEY_SPEC}, {FEATURE_SPEC}", _line_features_sql(),
          note="all line items as ONE series: block form spreads it over many tasks")
def q_features_single_series_blocked(spark, sf_dir):
    return features(td.line_series(spark, sf_dir), block_rows=16384)


@register("features_single_series_plain", f"{KEY_SPEC}, {FEATURE_SPEC}", _line_features_sql(),
          note="same input in smaller blocks; the plain window form lives in the tests only")
def q_features_single_series_plain(spark, sf_dir):
    return features(td.line_series(spark, sf_dir), block_rows=4096)


def _as_of_sql():
    extra, body = features_sql("draws")
    body = body.replace("FROM f3", """, lead(result) OVER (PARTITION BY lottery ORDER BY seq) AS target,
  lead(series) OVER (PARTITION BY lottery ORDER BY seq) AS target_series
FROM f3""")
    extra[0] = extra[0].replace("SELECT lottery, seq, fecha, result,", "SELECT lottery, seq, fecha, result, series,", 1)
    return td.with_ctes(["draws"], body, extra)


@register("seq_events_range", "lottery str, event_id int, seq int", td.with_ctes(
    ["event_series"], "SELECT lottery, event_id, seq FROM event_series"))
def q_seq_events_range(spark, sf_dir):
    """Distributed seq with sampled range partitioning (skew-proof variant)."""
    from ..operators.sequence import add_seq_range
    e = td.table(spark, sf_dir, "events").select(F.col("event_type").alias("lottery"), "ts", "event_id")
    return add_seq_range(e, "lottery", ["ts", "event_id"])


@register("features_as_of", f"{KEY_SPEC}, {FEATURE_SPEC}, target nint, target_series str", _as_of_sql())
def q_features_as_of(spark, sf_dir):
    """Features of draw i labelled with draw i+1 (block form)."""
    return features(td.draws(spark, sf_dir), mode="as_of", block_rows=512)
