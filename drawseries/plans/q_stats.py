"""Queries for aggregations, training history, ranking and alerts
(A1–A13, W43, W44, T1–T9, U1, U2, L1, L2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import DIGIT_COLUMNS
from ..operators import alerts as AL
from ..operators import rank as R
from ..operators import stats as ST
from ..operators import training as TR
from ..operators.catalog import dedupe_last
from ..sources import testdata as td
from .registry import register

POS = DIGIT_COLUMNS
PLACES = (1000, 100, 10, 1)


def _dig(x, p):
    return f"(CAST(floor(({x}) / {p}) AS BIGINT) % 10)"


# -- A1 / A2 ----------------------------------------------------------------

@register("profile", "n_rows int, min_fecha date, max_fecha date, n_lotteries int, signs str",
          td.with_ctes(["draws"], """
SELECT count(*) AS n_rows, min(fecha) AS min_fecha, max(fecha) AS max_fecha,
       count(DISTINCT lottery) AS n_lotteries,
       array_to_string(list_sort(list_distinct(list(series))), ',') AS signs
FROM draws"""))
def q_profile(spark, sf_dir):
    return ST.profile(td.draws(spark, sf_dir))


@register("count_by_lottery", "lottery str, n int", td.with_ctes(
    ["raw"], "SELECT lottery, count(*) AS n FROM raw GROUP BY lottery"))
def q_count_by_lottery(spark, sf_dir):
    return ST.count_by_lottery(td.raw_draws(spark, sf_dir))


# -- A4 / A5 / A6 -----------------------------------------------------------

_ACC_COLS = ", ".join(f"{n}_acc dbl" for n in POS)


@register("accuracy", f"lottery str, n int, {_ACC_COLS}, exact_acc dbl, series_acc dbl, result_acc dbl",
          td.with_ctes(["pairs"], f"""
SELECT *, ({' + '.join(f'{n}_acc' for n in POS)}) / 4 AS result_acc FROM (
  SELECT lottery, count(*) AS n,
    {', '.join(f'avg(CASE WHEN {_dig("pred", p)} = {_dig("real", p)} THEN 1.0 ELSE 0.0 END) AS {n}_acc' for n, p in zip(POS, PLACES))},
    avg(CASE WHEN pred = real THEN 1.0 ELSE 0.0 END) AS exact_acc,
    avg(CASE WHEN pred_series = real_series THEN 1.0 ELSE 0.0 END) AS series_acc
  FROM pairs GROUP BY lottery) a"""))
def q_accuracy(spark, sf_dir):
    return ST.accuracy(ST.persistence_predictions(td.draws(spark, sf_dir)))


@register("classification_report",
          "lottery str, cls str, support int, predicted int, tp int, precision dbl, recall dbl, f1 dbl, macro_f1 dbl",
          td.with_ctes(["pairs"], """
SELECT c.*, avg(f1) OVER (PARTITION BY lottery) AS macro_f1 FROM (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (
    SELECT lottery, cls, support, predicted, tp,
           CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
    FROM (
      SELECT lottery, cls, sum(sup) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM (
        SELECT lottery, real_series AS cls, 1 AS sup, 0 AS prd, CASE WHEN real_series = pred_series THEN 1 ELSE 0 END AS tp FROM pairs
        UNION ALL
        SELECT lottery, pred_series AS cls, 0, 1, 0 FROM pairs) u
      GROUP BY lottery, cls) g) p) c"""))
def q_classification_report(spark, sf_dir):
    pairs = ST.persistence_predictions(td.draws(spark, sf_dir))
    return ST.classification_report(pairs, "real_series", "pred_series")


@register("balanced_weights", "lottery str, series str, n_c int, n int, k int, weight dbl",
          td.with_ctes(["draws"], """
SELECT c.lottery, c.series, c.n_c, t.n, t.k, CAST(t.n AS DOUBLE) / (t.k * c.n_c) AS weight
FROM (SELECT lottery, series, count(*) AS n_c FROM draws GROUP BY lottery, series) c
JOIN (SELECT lottery, count(*) AS n, count(DISTINCT series) AS k FROM draws GROUP BY lottery) t
  ON c.lottery = t.lottery"""))
def q_balanced_weights(spark, sf_dir):
    return ST.balanced_weights(td.draws(spark, sf_dir), "series")


# -- A7 / A8 / W43 / W44 ----------------------------------------------------

@register("training_summary",
          "run_id int, lottery str, iterations int, best_result_acc dbl, mean_result_acc dbl, "
          "first_result_acc dbl, last_result_acc dbl, best_result_f1 dbl, best_series_acc dbl, "
          "mean_series_acc dbl, first_series_acc dbl, last_series_acc dbl, best_series_f1 dbl, "
          "improvement_result dbl, improvement_series dbl, duration_sec int",
          td.with_ctes(["history"], """
SELECT *, best_result_acc - first_result_acc AS improvement_result,
       best_series_acc - first_series_acc AS improvement_series
FROM (
  SELECT run_id, lottery, count(*) AS iterations,
    max(result_acc) AS best_result_acc, avg(result_acc) AS mean_result_acc,
    arg_min(result_acc, attempt) AS first_result_acc, arg_max(result_acc, attempt) AS last_result_acc,
    coalesce(max(result_f1), 0.0) AS best_result_f1,
    max(series_acc) AS best_series_acc, avg(series_acc) AS mean_series_acc,
    arg_min(series_acc, attempt) AS first_series_acc, arg_max(series_acc, attempt) AS last_series_acc,
    coalesce(max(series_f1), 0.0) AS best_series_f1,
    epoch(max(ts)) - epoch(min(ts)) AS duration_sec
  FROM history GROUP BY run_id, lottery) s"""))
def q_training_summary(spark, sf_dir):
    return TR.training_summary(td.history(spark, sf_dir))


_RB_SQL = """rb AS (
  SELECT *, sum(CASE WHEN improved_result OR improved_series THEN 1 ELSE 0 END)
              OVER (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS improvements
  FROM (
    SELECT *, result_acc > prev_r AS improved_result, series_acc > prev_s AS improved_series,
           greatest(prev_r, result_acc) AS best_result, greatest(prev_s, series_acc) AS best_series
    FROM (
      SELECT *, coalesce(max(result_acc) OVER (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev_r,
                coalesce(max(series_acc) OVER (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev_s
      FROM history) a) b)"""


@register("running_best",
          "run_id int, attempt int, improved_result bool, improved_series bool, best_result dbl, "
          "best_series dbl, improvements int",
          td.with_ctes(["history"], "SELECT * FROM rb", [_RB_SQL]))
def q_running_best(spark, sf_dir):
    return TR.running_best(td.history(spark, sf_dir))


@register("converged", "run_id int, attempt int, converged bool, range_result dbl, range_series dbl, stop_attempt nint",
          td.with_ctes(["history"], """
SELECT *, min(CASE WHEN converged THEN attempt END) OVER (PARTITION BY run_id) AS stop_attempt FROM (
  SELECT run_id, attempt, range_result, range_series,
         attempt >= 5 AND result_acc >= 0.05 AND series_acc >= 0.05 AND n = 50
           AND range_result < 0.002 AND range_series < 0.002 AS converged
  FROM (
    SELECT *, count(*) OVER w AS n,
           max(result_acc) OVER w - min(result_acc) OVER w AS range_result,
           max(series_acc) OVER w - min(series_acc) OVER w AS range_series
    FROM history
    WINDOW w AS (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) a) b"""))
def q_converged(spark, sf_dir):
    return TR.converged(td.history(spark, sf_dir))


@register("plateau", "run_id int, attempt int, since_improvement int, stop bool, stop_attempt nint",
          td.with_ctes(["history"], """
SELECT *, min(CASE WHEN stop THEN attempt END) OVER (PARTITION BY run_id) AS stop_attempt FROM (
  SELECT run_id, attempt, since_improvement, since_improvement >= 5 AS stop FROM (
    SELECT *, attempt - coalesce(max(CASE WHEN improved_result OR improved_series THEN attempt END)
              OVER (PARTITION BY run_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
              AS since_improvement
    FROM rb) a) b""", [_RB_SQL]))
def q_plateau(spark, sf_dir):
    return TR.plateau(td.history(spark, sf_dir))


# -- A9 / A10 / A11 / A13 ---------------------------------------------------

@register("lag_corr", "lottery str, corr_result dbl, corr_diff dbl, corr_units dbl, corr_dsum dbl",
          td.with_ctes(["draws"], f"""
SELECT lottery, corr(result, p_result) AS corr_result, corr(diff, p_diff) AS corr_diff,
       corr(units, p_units) AS corr_units, corr(dsum, p_dsum) AS corr_dsum
FROM (
  SELECT *, lag(result) OVER w AS p_result, lag(diff) OVER w AS p_diff,
         lag(units) OVER w AS p_units, lag(dsum) OVER w AS p_dsum
  FROM (SELECT lottery, seq, result, result - lag(result) OVER (PARTITION BY lottery ORDER BY seq) AS diff,
               result % 10 AS units, {' + '.join(_dig('result', p) for p in PLACES)} AS dsum
        FROM draws) x
  WINDOW w AS (PARTITION BY lottery ORDER BY seq)) y
GROUP BY lottery"""))
def q_lag_corr(spark, sf_dir):
    return ST.lag_corr(td.draws(spark, sf_dir))


@register("acf", "lottery str, lag int, acf dbl, is_peak bool", td.with_ctes(["draws"], """
SELECT c.lottery, c.lag, CASE WHEN z.c0 <> 0 THEN c.ck / z.c0 END AS acf,
       coalesce(c.lag >= 1 AND z.c0 <> 0 AND abs(c.ck / z.c0) > 0.15, false) AS is_peak
FROM (
  SELECT a.lottery, l.k AS lag, coalesce(sum(a.xc * b.xc), 0.0) AS ck
  FROM x a CROSS JOIN range(0, 61) l(k)
  LEFT JOIN x b ON b.lottery = a.lottery AND b.seq = a.seq + l.k
  GROUP BY a.lottery, l.k) c
JOIN (SELECT lottery, sum(xc * xc) AS c0 FROM x GROUP BY lottery) z ON c.lottery = z.lottery""",
    ["x AS (SELECT lottery, seq, result - avg(result) OVER (PARTITION BY lottery) AS xc FROM draws)"]))
def q_acf(spark, sf_dir):
    return ST.acf(td.draws(spark, sf_dir), nlags=60, threshold=0.15, block_rows=512)


_CORR_PAIRS = [(a, b) for i, a in enumerate(POS) for b in POS[i + 1:]]


@register("digit_corr", "lottery str, " + ", ".join(f"corr_{a}_{b} dbl" for a, b in _CORR_PAIRS),
          td.with_ctes(["draws"], "SELECT lottery, " + ", ".join(
              f"corr({_dig('result', PLACES[POS.index(a)])}, {_dig('result', PLACES[POS.index(b)])}) AS corr_{a}_{b}"
              for a, b in _CORR_PAIRS) + " FROM draws GROUP BY lottery"))
def q_digit_corr(spark, sf_dir):
    return ST.digit_corr(td.draws(spark, sf_dir))


@register("baselines",
          "lottery str, classes_seen int, signs_seen int, n_pairs int, repeat_exact dbl, repeat_digit dbl, "
          "repeat_sign dbl, chance_exact dbl, chance_digit dbl, chance_sign dbl, lift_exact dbl, lift_digit dbl",
          td.with_ctes(["pairs"], f"""
SELECT s.lottery, classes_seen, signs_seen, n_pairs, repeat_exact, repeat_digit, repeat_sign,
       1.0 / classes_seen AS chance_exact, 0.1 AS chance_digit, 1.0 / signs_seen AS chance_sign,
       repeat_exact * classes_seen AS lift_exact, repeat_digit / 0.1 AS lift_digit
FROM (SELECT lottery, count(DISTINCT result) AS classes_seen, count(DISTINCT series) AS signs_seen
      FROM draws GROUP BY lottery) s
JOIN (SELECT lottery, count(*) AS n_pairs, avg(CASE WHEN pred = real THEN 1.0 ELSE 0.0 END) AS repeat_exact,
             ({' + '.join(f'avg(CASE WHEN {_dig("pred", p)} = {_dig("real", p)} THEN 1.0 ELSE 0.0 END)' for p in PLACES)}) / 4 AS repeat_digit,
             avg(CASE WHEN pred_series = real_series THEN 1.0 ELSE 0.0 END) AS repeat_sign
      FROM pairs GROUP BY lottery) a ON s.lottery = a.lottery"""))
def q_baselines(spark, sf_dir):
    return ST.baselines(td.draws(spark, sf_dir))


# -- A12 --------------------------------------------------------------------

@register("dedupe_last", "fecha date, lottery str, result int, series str, k int", td.with_ctes(["raw"], """
SELECT fecha, lottery, result, series, k FROM (
  SELECT *, row_number() OVER (PARTITION BY fecha, lottery ORDER BY k DESC) AS rn FROM raw) r WHERE rn = 1"""))
def q_dedupe_last(spark, sf_dir):
    return dedupe_last(td.raw_draws(spark, sf_dir), ["fecha", "lottery"], ["k"])


# -- T1 T2 T3 ---------------------------------------------------------------

@register("order_by_date", "lottery str, fecha date, result int", td.with_ctes(
    ["draws"], "SELECT lottery, fecha, result FROM draws ORDER BY fecha DESC"))
def q_order_by_date(spark, sf_dir):
    return R.order_by_date(td.draws(spark, sf_dir).select("lottery", "fecha", "result"), descending=True)


@register("latest_row", "lottery str, seq int, fecha date, result int, series str", td.with_ctes(["draws"], """
SELECT lottery, seq, fecha, result, series FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY seq DESC) AS rn FROM draws) d WHERE rn = 1"""))
def q_latest_row(spark, sf_dir):
    return R.latest_row(td.draws(spark, sf_dir))


@register("last_n", "lottery str, seq int, fecha date, result int", td.with_ctes(["draws"], """
SELECT lottery, seq, fecha, result FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY seq DESC) AS rn FROM draws) d WHERE rn <= 5"""))
def q_last_n(spark, sf_dir):
    return R.last_n(td.draws(spark, sf_dir).select("lottery", "seq", "fecha", "result"), 5)


@register("first_n", "fecha date, lottery str, result int", td.with_ctes(
    ["draws"], "SELECT fecha, lottery, result FROM draws ORDER BY fecha, lottery LIMIT 5"))
def q_first_n(spark, sf_dir):
    return R.first_n(td.draws(spark, sf_dir).select("fecha", "lottery", "result"), 5, ["fecha", "lottery"])


# -- T4 / T5 ----------------------------------------------------------------

@register("top3_numbers", "lottery str, rank int, number int, prob dbl", td.with_ctes(["digit_scores"], """
SELECT lottery, rank, number, prob FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY prob DESC, number) AS rank FROM (
    SELECT a.lottery, a.digit * 1000 + b.digit * 100 + c.digit * 10 + d.digit AS number,
           -(-(a.score * b.score * c.score * d.score)) AS prob
    FROM best a
    JOIN best b ON a.lottery = b.lottery AND b.position = 1
    JOIN best c ON a.lottery = c.lottery AND c.position = 2
    JOIN best d ON a.lottery = d.lottery AND d.position = 3
    WHERE a.position = 0) combos) r
WHERE rank <= 3""", ["""best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery, position ORDER BY score DESC, digit) AS r
  FROM digit_scores) s WHERE r <= 2)"""]))
def q_top3_numbers(spark, sf_dir):
    return R.top3_numbers(td.digit_scores(spark, sf_dir))


@register("top3_classes", "lottery str, position int, rank int, cls int, prob dbl", td.with_ctes(["digit_scores"], """
SELECT lottery, position, rank, digit AS cls, score AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery, position ORDER BY score DESC, digit) AS rank
  FROM full_scores) s WHERE rank <= 3""", ["""full_scores AS (
  SELECT g.lottery, g.position, d.digit, coalesce(s.score, 0.0) AS score
  FROM (SELECT DISTINCT lottery, position FROM digit_scores) g CROSS JOIN range(0, 10) d(digit)
  LEFT JOIN digit_scores s ON s.lottery = g.lottery AND s.position = g.position AND s.digit = d.digit)"""]))
def q_top3_classes(spark, sf_dir):
    s = td.digit_scores(spark, sf_dir)
    # probability vector per (lottery, position): 10 slots, bounded by the digit domain
    proba = s.groupBy("lottery", "position").agg(
        F.map_from_entries(F.collect_list(F.struct("digit", "score"))).alias("_m")) \
        .select("lottery", "position", F.transform(F.sequence(F.lit(0), F.lit(9)),
                lambda d: F.coalesce(F.try_element_at(F.col("_m"), d.cast("bigint")), F.lit(0.0))).alias("proba"))
    return R.top3_classes(proba, keys=("lottery", "position"))


# -- T6 T7 T8 T9 ------------------------------------------------------------

_REG = """reg AS (
  SELECT run_id, lottery, attempt, k, ts, 'result' AS target, result_acc AS accuracy, result_f1 AS f1 FROM history
  UNION ALL
  SELECT run_id, lottery, attempt, k, ts, 'series' AS target, series_acc AS accuracy, series_f1 AS f1 FROM history)"""


@register("best_model", "lottery str, target str, run_id int, attempt int, k int, accuracy dbl",
          td.with_ctes(["history"], """
SELECT lottery, target, run_id, attempt, k, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery, target ORDER BY coalesce(accuracy, 0.0) DESC, k) AS rn
  FROM reg) r WHERE rn = 1""", [_REG]))
def q_best_model(spark, sf_dir):
    return TR.best_model(TR.registry_long(td.history(spark, sf_dir)))


@register("keep_two_slots", "lottery str, target str, slot int, run_id int, attempt int, k int, accuracy dbl",
          td.with_ctes(["history"], """
SELECT lottery, target, slot, run_id, attempt, k, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery, target ORDER BY coalesce(accuracy, 0.0) DESC, k) AS slot
  FROM reg) r WHERE slot <= 2""", [_REG]))
def q_keep_two_slots(spark, sf_dir):
    return TR.keep_two_slots(TR.registry_long(td.history(spark, sf_dir)))


@register("retain_top_runs", "lottery str, run_id int, best_result dbl, best_series dbl, score dbl, rank int",
          td.with_ctes(["history"], """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY score DESC, run_id) AS rank FROM (
    SELECT lottery, run_id, best_result, best_series, (best_result + best_series) / 2 AS score FROM (
      SELECT lottery, run_id, coalesce(max(result_acc), 0.0) AS best_result,
             coalesce(max(series_acc), 0.0) AS best_series
      FROM history GROUP BY lottery, run_id) a) b) c WHERE rank <= 3"""))
def q_retain_top_runs(spark, sf_dir):
    return TR.retain_top_runs(td.history(spark, sf_dir))


@register("leaderboard", "run_id int, attempt int, result_acc dbl, rank int, population int, is_elite bool, in_pool bool",
          td.with_ctes(["history"], """
SELECT *, rank <= 2 AS is_elite, rank <= greatest(2, floor(population / 2)) AS in_pool FROM (
  SELECT run_id, attempt, result_acc,
         row_number() OVER (PARTITION BY run_id ORDER BY result_acc DESC, attempt) AS rank,
         count(*) OVER (PARTITION BY run_id) AS population
  FROM history) r"""))
def q_leaderboard(spark, sf_dir):
    return TR.leaderboard(td.history(spark, sf_dir))


# -- U1 / U2 ----------------------------------------------------------------

@register("concat_lotteries", "lottery str, fecha date, result int", td.with_ctes(
    ["draws"], "SELECT lottery, fecha, result FROM draws"))
def q_concat_lotteries(spark, sf_dir):
    d = td.draws(spark, sf_dir).select("lottery", "fecha", "result")
    return R.concat_lotteries([d.filter(F.col("lottery") == n) for n in td.LOTTERIES]
                              + [d.filter(~F.col("lottery").isin(*td.LOTTERIES))])


@register("distinct_values", "lottery str, series str", td.with_ctes(
    ["draws"], "SELECT DISTINCT lottery, series FROM draws"))
def q_distinct_values(spark, sf_dir):
    return R.distinct_values(td.draws(spark, sf_dir), ["lottery", "series"])


# -- L1 / L2 ----------------------------------------------------------------

_ALERTS_SQL = """al AS (
  SELECT * FROM (
    SELECT run_id, lottery, attempt, k, ts, target AS model_type, accuracy, f1,
      CASE WHEN f1 IS NOT NULL AND f1 < 0.45 THEN 'CRITICAL' WHEN accuracy < 0.5 THEN 'CRITICAL'
           WHEN accuracy < 0.6 THEN 'WARNING' WHEN f1 IS NOT NULL AND f1 < 0.55 THEN 'WARNING' END AS level,
      CASE WHEN f1 IS NOT NULL AND f1 < 0.45 THEN 'f1_' || target WHEN accuracy < 0.6 THEN 'accuracy_' || target
           WHEN f1 IS NOT NULL AND f1 < 0.55 THEN 'f1_' || target END AS metric_name,
      CASE WHEN f1 IS NOT NULL AND f1 < 0.45 THEN f1 WHEN accuracy < 0.6 THEN accuracy
           WHEN f1 IS NOT NULL AND f1 < 0.55 THEN f1 END AS value,
      CASE WHEN f1 IS NOT NULL AND f1 < 0.45 THEN 0.45 WHEN accuracy < 0.5 THEN 0.5 WHEN accuracy < 0.6 THEN 0.6
           WHEN f1 IS NOT NULL AND f1 < 0.55 THEN 0.55 END AS threshold
    FROM reg) a WHERE level IS NOT NULL)"""
ALERT_SPEC = ("run_id int, lottery str, attempt int, k int, model_type str, level str, metric_name str, "
              "value dbl, threshold dbl")


def _alerts(spark, sf_dir):
    reg = TR.registry_long(td.history(spark, sf_dir)).withColumnRenamed("target", "model_type")
    return AL.alerts(reg)


@register("alerts", ALERT_SPEC, td.with_ctes(["history"], "SELECT * FROM al", [_REG, _ALERTS_SQL]))
def q_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@register("recent_alerts", ALERT_SPEC, td.with_ctes(
    ["history"], "SELECT * FROM al ORDER BY ts DESC, k DESC, model_type DESC LIMIT 10", [_REG, _ALERTS_SQL]))
def q_recent_alerts(spark, sf_dir):
    return AL.recent(_alerts(spark, sf_dir))


@register("alerts_by_lottery", ALERT_SPEC, td.with_ctes(
    ["history"], "SELECT * FROM al WHERE lottery = '2-HIGH'", [_REG, _ALERTS_SQL]))
def q_alerts_by_lottery(spark, sf_dir):
    return AL.by_lottery(_alerts(spark, sf_dir), "2-HIGH")
