"""Set-based forms of sequential rules equal a step-by-step simulation:
two model slots (T7), running best / plateau (A8, W44), convergence (W43),
alert precedence (L1)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from drawseries.operators import alerts as AL
from drawseries.operators import training as TR


def _history(spark, runs=6, attempts=70, seed=5):
    rnd = random.Random(seed)
    rows, k = [], 0
    for run in range(runs):
        flat = run == 0
        for a in range(1, attempts + 1):
            k += 1
            ra = 0.5 if flat else round(rnd.choice([0.1, 0.2, 0.3, 0.3, 0.4, rnd.random()]), 3)
            sa = 0.5 if flat else round(rnd.choice([0.2, 0.2, 0.5, rnd.random()]), 3)
            f1 = None if rnd.random() < 0.1 else round(rnd.random(), 3)
            rows.append((run, f"L{run % 2}", a, k, ra, sa, f1, f1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)))
    return spark.createDataFrame(rows, "run_id int, lottery string, attempt int, k bigint, result_acc double, "
                                       "series_acc double, result_f1 double, series_f1 double, ts timestamp"), rows


def test_two_slots_equal_sequential_registration(spark):
    df, rows = _history(spark)
    reg = TR.registry_long(df)
    got = {}
    for r in TR.keep_two_slots(reg).collect():
        got.setdefault((r.lottery, r.target), set()).add(r.k)
    want = {}
    for target, col in (("result", 4), ("series", 5)):
        slots = {}
        for row in sorted(rows, key=lambda x: x[3]):           # registration order
            key = (row[1], target)
            cur = slots.setdefault(key, [])
            acc = row[col] or 0.0
            if len(cur) < 2:
                cur.append((acc, row[3]))
            else:
                worst = min(cur, key=lambda x: (x[0], -x[1]))  # lowest accuracy, newest on ties
                if acc > worst[0]:
                    cur.remove(worst)
                    cur.append((acc, row[3]))
        for key, cur in slots.items():
            want[key] = {k for _, k in cur}
    assert got == want


def test_running_best_and_plateau_equal_simulation(spark):
    df, rows = _history(spark)
    got = {(r.run_id, r.attempt): (r.improvements, r.since_improvement, r.stop_attempt)
           for r in TR.plateau(df, patience=5).collect()}
    for run in {r[0] for r in rows}:
        best_r = best_s = 0.0
        imps, last_imp, stop = 0, 0, None
        seq = sorted((r for r in rows if r[0] == run), key=lambda x: x[2])
        expect = {}
        for r in seq:
            improved = False
            if r[4] > best_r:
                best_r, improved = r[4], True
            if r[5] > best_s:
                best_s, improved = r[5], True
            if improved:
                imps, last_imp = imps + 1, r[2]
            since = r[2] - last_imp
            if stop is None and since >= 5:
                stop = r[2]
            expect[r[2]] = (imps, since)
        for a, (imps_e, since_e) in expect.items():
            assert got[(run, a)][:2] == (imps_e, since_e)
            assert got[(run, a)][2] == stop


def test_convergence_fires_only_on_flat_runs(spark):
    df, _ = _history(spark)
    stops = {r.run_id: r.stop_attempt for r in TR.converged(df).select("run_id", "stop_attempt").distinct().collect()}
    assert stops[0] == 50
    assert all(v is None for run, v in stops.items() if run != 0)


def test_alert_precedence(spark):
    cases = [  # accuracy, f1 -> (level, metric)
        (0.40, 0.40, ("CRITICAL", "f1_result")),
        (0.40, 0.50, ("CRITICAL", "accuracy_result")),
        (0.55, 0.50, ("WARNING", "accuracy_result")),
        (0.70, 0.50, ("WARNING", "f1_result")),
        (0.70, None, None),
        (0.45, None, ("CRITICAL", "accuracy_result")),
        (0.70, 0.60, None),
    ]
    df = spark.createDataFrame([(i, "result", a, f) for i, (a, f, _) in enumerate(cases)],
                               "i int, model_type string, accuracy double, f1 double")
    got = {r.i: (r.level, r.metric_name) for r in AL.alerts(df).collect()}
    want = {i: e for i, (_, _, e) in enumerate(cases) if e is not None}
    assert got == want
    assert AL.alerts(df).filter(F.col("i") == 0).first().threshold == 0.45


def _plain_improvements(rows, run):
    """(attempt -> (improvements, since, best_result)) by stepping through a run."""
    best_r = best_s = 0.0
    imps, last, out = 0, 0, {}
    for r in sorted((r for r in rows if r[0] == run), key=lambda x: x[2]):
        if r[4] > best_r or r[5] > best_s:
            imps, last = imps + 1, r[2]
        best_r, best_s = max(best_r, r[4]), max(best_s, r[5])
        out[r[2]] = (imps, r[2] - last, best_r)
    return out


def test_segmented_scans_equal_the_plain_form_at_any_block_size(spark):
    df, rows = _history(spark, runs=4, attempts=170)
    want = {(run, a): v for run in range(4) for a, v in _plain_improvements(rows, run).items()}
    plain = {(r.run_id, r.attempt): (r.converged, r.range_result, r.stop_attempt) for r in TR.converged(df).collect()}
    for size in (1, 7, 64, 1000):
        got = {(r.run_id, r.attempt): (r.improvements, r.since_improvement, r.best_result)
               for r in TR.plateau(df, block_rows=size).collect()}
        assert got == want
        assert {(r.run_id, r.attempt): r.improvements for r in TR.running_best(df, block_rows=size).collect()} == {
            k: v[0] for k, v in want.items()}
        assert {(r.run_id, r.attempt): (r.converged, r.range_result, r.stop_attempt)
                for r in TR.converged(df, block_rows=size).collect()} == plain


def test_no_window_over_the_rows_of_a_run(spark):
    """Windows over rows are partitioned by run and block; a run's blocks alone are prefixed per run."""
    df, _ = _history(spark)
    for out in (TR.running_best(df), TR.plateau(df), TR.converged(df), TR.leaderboard(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_b#" in line or "_t#" in line, line


def test_leaderboard_ranks_ties_and_missing_fitness(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, None), (1, 4, 0.9), (2, 1, None)],
                               "run_id int, attempt int, result_acc double")
    got = {(r.run_id, r.attempt): (r.rank, r.population, r.is_elite, r.in_pool) for r in TR.leaderboard(df).collect()}
    assert got == {(1, 4): (1, 4, True, True), (1, 1): (2, 4, True, True), (1, 2): (3, 4, False, False),
                   (1, 3): (4, 4, False, False), (2, 1): (1, 1, True, True)}
