"""Model, registry and prediction-sink queries.

MLlib fits are randomised by design, so these queries return what must hold of
any right fit, per lottery and target, and their SQL states it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import forest as FO
from ..operators import model as M
from ..operators import registry as RG
from ..operators import training as TR
from ..operators.features import features
from ..session import checkpoint, ensure_checkpoint_dir
from ..sources import tabular as S
from ..sources import testdata as td
from .registry import register

SMALL = M.Candidate(n_estimators=10, max_depth=5, min_samples_split=2, seed=42)


def _frame(spark, sf_dir, test_size=None):
    """As-of rows of every draw with labels and vectors, stored once by lottery (and split): labelled, newest, sign labels."""
    return M.stored_frame(td.draws(spark, sf_dir), test_size, 42)


def _lotteries(df, train=None):
    """Series to model: those with enough training rows (P11 gate)."""
    return M.eligible_lotteries(train if train is not None else df, min_rows=50)


# Random forests differ from run to run of another engine, so these queries return
# what holds for any right result; their SQL states it per lottery and target.
_TEST = "(('0x' || substr(md5(lottery || ':' || seq || ':42'), 1, 13))::BIGINT % 1000) < 200"
_LOTS = "lots AS (SELECT lottery, count(*) - 1 AS n_train FROM draws GROUP BY lottery HAVING count(*) - 1 >= 50)"
_SPLIT = f"""split AS (SELECT lottery, count(*) AS n FROM (
  SELECT lottery, seq, max(seq) OVER (PARTITION BY lottery) AS last FROM draws) s
  WHERE seq < last AND {_TEST} GROUP BY lottery)"""
_RANKS = "ranks AS (SELECT unnest([1, 2, 3]) AS rank)"
_TARGET = "targets AS (SELECT unnest(['result', 'series']) AS target)"
CANDIDATES = M.draw_candidates(M.GRID_TEST, 4, rng_seed=1)
_CANDS = "cands AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {c.n_estimators}, {c.max_depth})" for i, c in enumerate(CANDIDATES)) + ") c(candidate, n_estimators, max_depth))"
UNREGISTERED = "6-NEW"            # a lottery without draws: what prediction does without a model


def _ml_sql(body, *extra):
    return td.with_ctes(["draws"], body, [_LOTS, *extra])


def _falling(prob, group="lottery"):
    """Whether a row's probability is in [0, 1] and at most that of the rank before."""
    before = F.lag(prob).over(Window.partitionBy(group).orderBy("rank"))
    return F.coalesce(F.col(prob).between(0, 1) & (before.isNull() | (F.col(prob) <= before)), F.lit(False))


def _share(c):
    return F.coalesce(F.col(c).between(0, 1), F.lit(False))


@register("ml_random_split", "lottery str, seq int, is_test bool", td.with_ctes(
    ["draws"], f"SELECT lottery, seq, {_TEST} AS is_test FROM draws"))
def q_ml_random_split(spark, sf_dir):
    as_of = features(td.draws(spark, sf_dir), mode="as_of", block_rows=4096)
    return M.random_split(as_of, 0.2, 42).select("lottery", "seq", "is_test")


@register("ml_predict_latest", "lottery str, rank int, number_ok bool, prob_ok bool", _ml_sql(
    "SELECT lottery, rank, true AS number_ok, true AS prob_ok FROM lots, ranks", _RANKS))
def q_ml_predict_latest(spark, sf_dir):
    train, latest, labels = _frame(spark, sf_dir)
    models = M.fit_per_lottery(train, SMALL, _lotteries(latest, train), stored=True)
    numbers, _signs = M.predict_latest(latest.withColumn("target", F.lit(None).cast("int")), models, labels)
    return numbers.select("lottery", "rank", F.col("number").between(0, 9999).alias("number_ok"), _falling("prob").alias("prob_ok"))


@register("ml_top3_signs", "lottery str, rank int, sign_ok bool, prob_ok bool", _ml_sql(
    "SELECT lottery, rank, true AS sign_ok, true AS prob_ok FROM lots, ranks", _RANKS))
def q_ml_top3_signs(spark, sf_dir):
    train, latest, labels = _frame(spark, sf_dir)
    models = M.fit_per_lottery(train, SMALL, _lotteries(latest, train), stored=True)
    _numbers, signs = M.predict_latest(latest.withColumn("target", F.lit(None).cast("int")), models, labels)
    return signs.select("lottery", "rank", F.col("sign").isin(*[c for c, _ in td.SIGN_NAMES]).alias("sign_ok"),
                        _falling("prob").alias("prob_ok"))


@register("ml_prediction_log", "lottery str, numero_ok bool, serie_ok bool, n_numbers int, n_signs int, modelo str", _ml_sql(
    "SELECT lottery, true AS numero_ok, true AS serie_ok, 3 AS n_numbers, 3 AS n_signs, 'rf' AS modelo FROM lots"))
def q_ml_prediction_log(spark, sf_dir):
    """H6 → S4: nested prediction records appended to a JSON log and read back."""
    train, latest, labels = _frame(spark, sf_dir)
    models = M.fit_per_lottery(train, SMALL, _lotteries(latest, train), stored=True)
    numbers, signs = M.predict_latest(latest.withColumn("target", F.lit(None).cast("int")), models, labels)
    path = f"{ensure_checkpoint_dir(spark)}/prediction_log_{uuid.uuid4().hex}"
    S.append_predictions(M.prediction_records(numbers, signs).drop("timestamp"), path)
    log = spark.read.json(path)
    return log.select("lottery", F.col("numero").rlike("^[0-9]{4}$").alias("numero_ok"),
                      F.col("serie").isin(*[c for c, _ in td.SIGN_NAMES]).alias("serie_ok"),
                      F.size("top3_numeros").alias("n_numbers"), F.size("top3_signos").alias("n_signs"), "modelo")


def _search(spark, sf_dir):
    train, _latest, _labels = _frame(spark, sf_dir, 0.2)
    return M.search(train, CANDIDATES, test_size=0.2, split_seed=42)


@register("ml_search", "candidate int, lottery str, n int, n_estimators int, max_depth int, acc_ok bool, rank_ok bool", _ml_sql(
    "SELECT candidate, s.lottery, s.n, n_estimators, max_depth, true AS acc_ok, true AS rank_ok FROM split s, cands",
    _SPLIT, _CANDS))
def q_ml_search(spark, sf_dir):
    board = TR.leaderboard(_search(spark, sf_dir).withColumnRenamed("candidate", "attempt"), group="lottery",
                           fitness="result_acc").withColumnRenamed("attempt", "candidate")
    return board.select("candidate", "lottery", "n", "n_estimators", "max_depth",
                        (_share("result_acc") & _share("series_acc")).alias("acc_ok"),
                        F.col("rank").between(1, len(CANDIDATES)).alias("rank_ok"))


@register("ml_select_best", "lottery str, target str, candidate_ok bool, acc_ok bool", _ml_sql(
    "SELECT lottery, target, true AS candidate_ok, true AS acc_ok FROM lots, targets", _TARGET))
def q_ml_select_best(spark, sf_dir):
    """H4: best candidate per (lottery, target) against a registered baseline."""
    registered = TR.registry_long(td.history(spark, sf_dir)).withColumn(
        "accuracy", F.col("accuracy") / 10)          # a weak registered baseline
    return M.select_best(_search(spark, sf_dir), registered).select(
        "lottery", "target", F.col("candidate").between(-1, len(CANDIDATES) - 1).alias("candidate_ok"), _share("accuracy").alias("acc_ok"))


@register("ml_feature_importance", "lottery str, target str, rank int, known bool, importance_ok bool", _ml_sql(
    "SELECT lottery, target, rank, true AS known, true AS importance_ok FROM lots, "
    f"(SELECT unnest({M.TARGETS}) AS target) t, (SELECT unnest(range(1, 11)) AS rank) r"))
def q_ml_feature_importance(spark, sf_dir):
    """The ten most important features of every lottery's models."""
    train, latest, _labels = _frame(spark, sf_dir)
    models = M.fit_per_lottery(train, SMALL, _lotteries(latest, train), stored=True)
    rows = [(lot, t, name in M.FEATURE_COLUMNS, 0 <= imp <= 1, i + 1) for lot, by in models.items() for t, m in by.items()
            for i, (name, imp) in enumerate(M.feature_importance(m))]
    return spark.createDataFrame(rows, "lottery string, target string, known boolean, importance_ok boolean, rank int")


@register("ml_score_dates", "fecha date, lottery str, numero_ok bool", td.with_ctes(["draws"], """
SELECT CAST(m.last + d.k AS DATE) AS fecha, lottery, true AS numero_ok
FROM (SELECT lottery, max(fecha) AS last FROM draws GROUP BY lottery HAVING count(*) - 1 >= 50) m,
     (SELECT CAST(unnest(range(1, 8)) AS INT) AS k) d"""))
def q_ml_score_dates(spark, sf_dir):
    train, latest, _labels = _frame(spark, sf_dir)
    models = M.fit_per_lottery(train, SMALL, _lotteries(latest, train), stored=True)
    got = M.score_dates(latest.withColumn("target", F.lit(None).cast("int")), models, next_n=7)
    return got.select("fecha", "lottery", F.col("numero").rlike("^[0-9]{4}$").alias("numero_ok"))


#: Least accuracy where the draws follow a rule, and the most where they follow none.
LEARNT, CHANCE = 0.9, 0.25
# rounds: the least of the reference's range (50 to 300)
BOOSTED = {"n_estimators": [50], "max_depth": [3], "min_samples_split": [2], "algorithm": ["gbt"], "learning_rate": [0.3],
           "subsample": [1.0]}


def _ruled_frame(spark, sf_dir):
    """As-of rows of the draws that follow a rule (F12), split and stored by lottery."""
    labelled, _latest, labels = M.stored_frame(td.ruled_draws(spark, sf_dir), 0.2, 42)
    return labelled, labels


def _held_out(frame, fit, cand):
    """(holdout rows scored by the models that ``fit`` makes of the training rows, the models)."""
    split = M.split_frame(frame, 0.2, 42)
    models = fit(split.filter(~F.col("is_test")), cand, M.eligible_lotteries(frame, 50), stored=True)
    return M.score(split.filter(F.col("is_test")), models), models


@register("ml_rule_accuracy", "lottery str, n int, learnt bool, chance bool", _ml_sql(
    "SELECT s.lottery, s.n, true AS learnt, true AS chance FROM split s JOIN lots USING (lottery)", _SPLIT),
          note="forests find a planted rule (all five accuracies over 0.9) and find none in the plain draws")
def q_ml_rule_accuracy(spark, sf_dir):
    ruled, _labels = _ruled_frame(spark, sf_dir)
    cand = M.Candidate(n_estimators=10, max_depth=8)
    scored, _ = _held_out(ruled, M.fit_per_lottery, cand)
    plain, _latest, _labels = _frame(spark, sf_dir, 0.2)
    none, _ = _held_out(plain, M.fit_per_lottery, SMALL)
    all_five = F.least(*[F.col(f"{d}_acc") for d in M.DIGITS], "series_acc")
    chance = M.accuracy_table(none).select("lottery", (F.greatest("result_acc", "series_acc") <= CHANCE).alias("chance"))
    return M.accuracy_table(scored).select("lottery", "n", (all_five >= LEARNT).alias("learnt")).join(chance, "lottery")


@register("ml_boosted_candidate", "lottery str, n int, n_targets int, sums_ok bool, argmax_ok bool, learnt bool", _ml_sql(
    "SELECT s.lottery, s.n, 5 AS n_targets, true AS sums_ok, true AS argmax_ok, true AS learnt FROM split s JOIN lots USING (lottery)",
    _SPLIT), note="boosted candidates for all five targets of every lottery, with probabilities, on the draws with a rule")
def q_ml_boosted(spark, sf_dir):
    """Drawn as the search draws them; every probability vector sums to 1."""
    cand = M.draw_candidates(BOOSTED, 1, rng_seed=1)[0]
    ruled, _labels = _ruled_frame(spark, sf_dir)
    scored, models = _held_out(ruled, M.fit_per_lottery, cand)
    scored = checkpoint(scored.select("lottery", *[f"{p}_{t[2:]}" for t in M.TARGETS for p in ("y", "pred", "prob")]))
    tags = [t[2:] for t in M.TARGETS]
    sums = F.greatest(*[F.abs(F.aggregate(f"prob_{t}", F.lit(0.0), lambda a, x: a + x) - 1) for t in tags])
    best = F.least(*[(F.element_at(f"prob_{t}", F.col(f"pred_{t}").cast("int") + 1) == F.array_max(f"prob_{t}")).cast("int") for t in tags])
    checks = scored.groupBy("lottery").agg((F.max(sums) < 1e-9).alias("sums_ok"), (F.min(best) == 1).alias("argmax_ok"))
    all_five = F.least(*[F.col(f"{d}_acc") for d in M.DIGITS], "series_acc")
    return M.accuracy_table(scored).join(checks, "lottery").select(
        "lottery", "n", F.lit(min(len(m) for m in models.values())).alias("n_targets"), "sums_ok", "argmax_ok",
        (all_five >= LEARNT).alias("learnt"))


@register("ml_warm_start", "lottery str, n int, n_trees int, learnt bool", _ml_sql(
    "SELECT s.lottery, s.n, 55 AS n_trees, true AS learnt FROM split s JOIN lots USING (lottery)", _SPLIT),
          note="five trees and fifty more for every lottery and target, on the draws with a rule")
def q_ml_warm_start(spark, sf_dir):
    ruled, _labels = _ruled_frame(spark, sf_dir)
    scored, models = _held_out(ruled, M.warm_start_fit, M.Candidate(n_estimators=5, max_depth=6))
    trees = min(m.getNumTrees for by in models.values() for m in by.values())
    all_five = F.least(*[F.col(f"{d}_acc") for d in M.DIGITS], "series_acc")
    return M.accuracy_table(scored).select("lottery", "n", F.lit(trees).alias("n_trees"), (all_five >= LEARNT).alias("learnt"))


def simulated_stop(accuracies: list[tuple[float, float]], patience: int) -> int | None:
    """First attempt at which neither best rose for ``patience`` attempts, stepping through a run's log."""
    best, last = [0.0, 0.0], 0
    for i, pair in enumerate(accuracies, 1):
        if any(a > b for a, b in zip(pair, best)):
            last = i
        best = [max(a, b) for a, b in zip(pair, best)]
        if i - last >= patience:
            return i
    return None


@register("search_history", "lottery str, numbered bool, stop_ok bool, ended_ok bool, summary_ok bool", _ml_sql(
    "SELECT lottery, true AS numbered, true AS stop_ok, true AS ended_ok, true AS summary_ok FROM lots"),
          note="a search that logs its attempts and stops by patience; the stop is stepped through from the logged accuracies")
def q_search_history(spark, sf_dir):
    ruled, _labels = _ruled_frame(spark, sf_dir)
    tries, patience = 4, 2
    grid = {"n_estimators": [3, 5], "max_depth": [2, 4], "min_samples_split": [2]}
    log = f"{ensure_checkpoint_dir(spark)}/search_{uuid.uuid4().hex}"
    history = M.search_history(ruled, M.draw_candidates(grid, tries, rng_seed=3), log, "search", patience,
                               lotteries=M.eligible_lotteries(ruled, 50))
    by: dict[str, list] = {}
    for r in history.orderBy("lottery", "attempt").collect():           # at most ``tries`` rows a lottery
        by.setdefault(r.lottery, []).append(r)
    stops = {r.lottery: r.stop_attempt for r in TR.plateau(history, patience).select("lottery", "stop_attempt").distinct().collect()}
    totals = {r.lottery: r for r in TR.training_summary(history).collect()}
    rows = []
    for lot, got in by.items():
        stop = simulated_stop([(r.result_acc, r.series_acc) for r in got], patience)
        rows.append((lot, [r.attempt for r in got] == list(range(1, len(got) + 1)), stops[lot] == stop,
                     len(got) == (stop or tries), totals[lot].iterations == len(got)
                     and totals[lot].best_result_acc == max(r.result_acc for r in got)))
    return spark.createDataFrame(rows, "lottery string, numbered boolean, stop_ok boolean, ended_ok boolean, summary_ok boolean")


def _registered(spark, sf_dir):
    """Fits every lottery on its training rows and registers ``result`` and ``series`` with accuracy and macro F1."""
    train, latest, labels = _frame(spark, sf_dir, 0.2)
    split = M.split_frame(train, 0.2, 42)
    lots = _lotteries(latest, train)
    models = M.fit_per_lottery(split.filter(~F.col("is_test")), SMALL, lots, stored=True)
    scored = checkpoint(M.score(split.filter(F.col("is_test")), models).select(
        "lottery", *[f"{p}_{t}" for t in [*M.DIGITS, "series"] for p in ("y", "pred")]))
    acc = {r["lottery"]: r for r in M.accuracy_table(scored).collect()}
    f1 = {(r["lottery"], r["target"]): r["f1"] for r in M.macro_f1(scored).collect()}
    n_rec = {r[0]: r[1] for r in train.groupBy("lottery").count().collect()}
    rows, saved = [], {}
    for lot in lots:
        for target in ("result", "series"):
            mid = uuid.uuid4().hex
            rows.append({"model_id": mid, "lottery": lot, "target": target, "accuracy": acc[lot][f"{target}_acc"],
                         "f1": f1[lot, target], "n_records": n_rec[lot], "params": SMALL.__dict__})
            saved[lot, target, mid] = {t: m for t, m in models[lot].items() if (t == "y_series") == (target == "series")}
    root = f"{ensure_checkpoint_dir(spark)}/registry_{uuid.uuid4().hex}"
    kept, _path = RG.register_if_better(spark, root, RG.entries(spark, rows), saved)
    return kept, root, latest, labels


@register("ml_register_models", "lottery str, target str, n_features int, acc_ok bool, f1_ok bool, has_path bool", _ml_sql(
    "SELECT lottery, target, 41 AS n_features, true AS acc_ok, true AS f1_ok, true AS has_path FROM lots, targets", _TARGET))
def q_ml_register_models(spark, sf_dir):
    kept, _root, _latest, _labels = _registered(spark, sf_dir)
    return kept.select("lottery", "target", "n_features", _share("accuracy").alias("acc_ok"), _share("f1").alias("f1_ok"),
                       F.col("model_path").endswith(F.col("model_id")).alias("has_path"))


@register("predict_from_registry", "lottery str, status str, n_numbers int, n_signs int", _ml_sql(
    f"SELECT lottery, 'ok' AS status, 3 AS n_numbers, 3 AS n_signs FROM lots "
    f"UNION ALL SELECT '{UNREGISTERED}', 'no_model', 0, 0"))
def q_predict_from_registry(spark, sf_dir):
    """T6 → load → H6 → S4: the best stored models predict; an added lottery without any gets a status row."""
    _kept, root, latest, labels = _registered(spark, sf_dir)
    names = [r[0] for r in latest.select("lottery").orderBy("lottery").collect()] + [UNREGISTERED]
    models, status = RG.best_models(spark, root, names)
    numbers, signs = M.predict_latest(latest.withColumn("target", F.lit(None).cast("int")), models, labels)
    path = f"{root}/predictions"
    S.append_predictions(M.prediction_records(numbers, signs).drop("timestamp"), path)
    log = spark.read.json(path).select("lottery", F.size("top3_numeros").alias("n_numbers"), F.size("top3_signos").alias("n_signs"))
    states = spark.createDataFrame(sorted(status.items()), "lottery string, status string")
    return states.join(log, "lottery", "left").select(
        "lottery", "status", F.coalesce("n_numbers", F.lit(0)).alias("n_numbers"), F.coalesce("n_signs", F.lit(0)).alias("n_signs"))


@register("score_registered", "lottery str, n int, n_targets int, sums_ok bool, learnt bool", _ml_sql(
    "SELECT s.lottery, s.n, 5 AS n_targets, true AS sums_ok, true AS learnt FROM split s JOIN lots USING (lottery)", _SPLIT),
          note="stored forests of all series and targets score the held-out rows in one join")
def q_score_registered(spark, sf_dir):
    """T6 → H3 over the table of stored forests: on the draws with a rule every target of every lottery is found."""
    ruled, _labels = _ruled_frame(spark, sf_dir)
    split = M.split_frame(ruled, 0.2, 42)
    cand = M.Candidate(n_estimators=10, max_depth=8)
    models = M.fit_per_lottery(split.filter(~F.col("is_test")), cand, M.eligible_lotteries(ruled, 50), stored=True)
    rows, saved = [], {}
    for lot in models:
        for target in ("result", "series"):
            mid = uuid.uuid4().hex
            rows.append({"model_id": mid, "lottery": lot, "target": target, "params": cand.__dict__})
            saved[lot, target, mid] = {t: m for t, m in models[lot].items() if (t == "y_series") == (target == "series")}
    root = f"{ensure_checkpoint_dir(spark)}/registry_{uuid.uuid4().hex}"
    RG.register_if_better(spark, root, RG.entries(spark, rows), saved)
    best = FO.forests_of(TR.best_model(RG.read_registry(spark, root)), FO.forest_table(spark, root))
    scores = FO.forest_scores(split.filter(F.col("is_test")), best)
    y = F.coalesce(*[F.when(F.col("label") == t, F.col(t)) for t in M.TARGETS])
    off = F.abs(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x) - 1)
    by_target = scores.groupBy("lottery", "label").agg(
        F.count("*").alias("n"), F.max(off).alias("off"), F.avg((F.col("pred") == y).cast("double")).alias("acc"))
    return by_target.groupBy("lottery").agg(
        F.max("n").alias("n"), F.count("*").alias("n_targets"), (F.max("off") < 1e-9).alias("sums_ok"),
        (F.min("acc") >= LEARNT).alias("learnt"))


@register("model_alerts", "lottery str, target str, level str, metric_name str", _ml_sql(
    "SELECT lottery, target, 'CRITICAL' AS level, 'f1_' || target AS metric_name FROM lots, targets", _TARGET))
def q_model_alerts(spark, sf_dir):
    """L1 fed from the registry: draws are random, so every model's macro F1 is far under the critical line."""
    from ..operators import alerts as AL
    kept, _root, _latest, _labels = _registered(spark, sf_dir)
    return AL.alerts(kept.select("lottery", "target", "accuracy", "f1"), model_type="target")


def _persistence_predictions(spark, sf_dir):
    from ..operators.rank import latest_row
    d = td.draws(spark, sf_dir)
    last = latest_row(d)
    return last.select("lottery", F.lpad(F.col("result").cast("string"), 4, "0").alias("numero"),
                       F.col("series").alias("serie"), F.lit("persistence").alias("modelo"))


_LATEST_SQL = td.with_ctes(["draws"], """
SELECT lottery, lpad(CAST(result AS VARCHAR), 4, '0') AS numero, series AS serie, 'persistence' AS modelo
FROM (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY seq DESC) AS rn FROM draws) d WHERE rn = 1""")


@register("append_predictions", "lottery str, numero str, serie str, modelo str",
          "SELECT * FROM (" + _LATEST_SQL + ") a UNION ALL SELECT * FROM (" + _LATEST_SQL + ") b")
def q_append_predictions(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/predictions_{uuid.uuid4().hex}"
    preds = _persistence_predictions(spark, sf_dir)
    S.append_predictions(preds, path, ts=dt.datetime(2024, 1, 1))
    S.append_predictions(preds, path, ts=dt.datetime(2024, 1, 2))
    return spark.read.json(path).select("lottery", "numero", "serie", "modelo")


@register("write_batch", "lottery str, numero str, serie str, modelo str", _LATEST_SQL)
def q_write_batch(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark)}/batch_{uuid.uuid4().hex}"
    path = S.write_batch(_persistence_predictions(spark, sf_dir), root, ts=dt.datetime(2024, 1, 1))
    return spark.read.json(path).select("lottery", "numero", "serie", "modelo")
