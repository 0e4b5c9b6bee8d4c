"""MLlib classifiers: schema, probabilities, a learnable rule, chance on noise."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from drawseries.operators import model as M
from drawseries.operators.features import features


def _draws(spark, learnable: bool, n=600):
    rnd = random.Random(11)
    vals = [rnd.randrange(10000)]
    for _ in range(n - 1):
        if learnable:   # next units digit = (previous units digit + 3) % 10
            nxt = rnd.randrange(1000) * 10 + (vals[-1] % 10 + 3) % 10
        else:
            nxt = rnd.randrange(10000)
        vals.append(nxt)
    signs = ["ARI", "TAU", "GEM"]
    rows = [("S", i + 1, dt.date(2020, 1, 1) + dt.timedelta(days=i), v, signs[i % 3])
            for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "lottery string, seq bigint, fecha date, result int, series string")


@pytest.fixture(scope="module")
def learnable(spark):
    as_of = features(_draws(spark, True), mode="as_of")
    frame, labels = M.training_frame(as_of)
    return as_of, frame.cache(), labels


def test_learnable_units_digit(spark, learnable):
    _as_of, frame, _labels = learnable
    split = M.random_split(frame, 0.25, 7)
    cand = M.Candidate(n_estimators=20, max_depth=8, seed=3)
    models = M.fit_digit_models(split.filter(~F.col("is_test")), cand, targets=["y_unidades"])
    scored = M.apply_models(split.filter(F.col("is_test")), models)
    acc = scored.select(F.avg((F.col("pred_unidades") == F.col("y_unidades")).cast("double"))).first()[0]
    assert acc > 0.9


def test_noise_near_chance(spark):
    as_of = features(_draws(spark, False), mode="as_of")
    frame, _ = M.training_frame(as_of)
    split = M.random_split(frame, 0.3, 7)
    models = M.fit_digit_models(split.filter(~F.col("is_test")), M.Candidate(n_estimators=10, max_depth=5),
                                targets=["y_unidades"])
    scored = M.apply_models(split.filter(F.col("is_test")), models)
    acc = scored.select(F.avg((F.col("pred_unidades") == F.col("y_unidades")).cast("double"))).first()[0]
    assert acc < 0.3


def test_predict_latest_shapes(spark, learnable):
    as_of, frame, labels = learnable
    models = M.fit_per_lottery(frame, M.Candidate(n_estimators=5, max_depth=4), ["S"])
    from pyspark.ml.feature import VectorAssembler
    latest = VectorAssembler(inputCols=M.FEATURE_COLUMNS, outputCol="features").transform(
        as_of.filter(F.col("target").isNull()))
    numbers, signs = M.predict_latest(latest, models, labels)
    n = numbers.orderBy("rank").collect()
    assert [r["rank"] for r in n] == [1, 2, 3]
    assert n[0]["prob"] >= n[1]["prob"] >= n[2]["prob"]
    s = signs.orderBy("rank").collect()
    assert len(s) == 3 and all(x["sign"] in labels for x in s)
    probs = M.apply_models(latest, models["S"]).select("prob_unidades").first()[0]
    assert abs(sum(probs) - 1.0) < 1e-9


def test_split_is_stable_and_shared(spark, learnable):
    _as_of, frame, _ = learnable
    a = M.random_split(frame, 0.2, 42).filter("is_test").select("seq")
    b = M.random_split(frame.repartition(5), 0.2, 42).filter("is_test").select("seq")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    share = a.count() / frame.count()
    assert 0.1 < share < 0.3


def test_feature_guard(spark, learnable):
    _as_of, frame, _ = learnable
    models = M.fit_digit_models(frame, M.Candidate(n_estimators=2, max_depth=2), targets=["y_miles"])
    from pyspark.ml.feature import VectorAssembler
    short = VectorAssembler(inputCols=M.FEATURE_COLUMNS[:5], outputCol="features").transform(
        frame.drop("features"))
    class Fake:
        numFeatures = 5
    with pytest.raises(ValueError):
        M.apply_models(short, {"y_miles": Fake()})
    assert models["y_miles"].numFeatures == 41


def test_select_best_is_per_target_and_respects_baseline(spark):
    res = spark.createDataFrame(
        [("L", 0, 0.30, 0.10), ("L", 1, 0.30, 0.20), ("L", 2, 0.25, 0.05)],
        "lottery string, candidate int, result_acc double, series_acc double")
    best = {(r.target): (r.candidate, r.accuracy) for r in M.select_best(res).collect()}
    assert best == {"result": (0, 0.30), "series": (1, 0.20)}      # ties keep the earlier candidate
    reg = spark.createDataFrame([("L", "series", 0.5, 7)], "lottery string, target string, accuracy double, k bigint")
    best = {(r.target): r.candidate for r in M.select_best(res, reg).collect()}
    assert best == {"result": 0, "series": -1}                      # the registered model stays


def test_score_dates_variants(spark, learnable):
    as_of, frame, labels = learnable
    models = M.fit_per_lottery(frame, M.Candidate(n_estimators=3, max_depth=3), ["S"])
    from pyspark.ml.feature import VectorAssembler
    latest = VectorAssembler(inputCols=M.FEATURE_COLUMNS, outputCol="features").transform(as_of)
    assert M.score_dates(latest, models, next_n=5).count() == 5
    assert M.score_dates(latest, models, start="2030-01-01", end="2030-01-10").count() == 10
    assert M.score_dates(latest, models, dates=["2030-02-01", "2030-03-01"]).count() == 2
    assert M.eligible_lotteries(frame, min_rows=10_000) == []


# -- walk-forward store, boosted one-vs-rest, live search ---------------------------

def test_walk_forward_folders_hold_what_a_fit_may_see(spark):
    from drawseries.operators import backtest as BT
    from drawseries.sources import testdata as td
    d = td.ruled_draws(spark, "/root/testdata/sf0.001")
    path, _labels = BT.walk_forward_store(d, window=20, retrain=8)
    frame = BT.read_walk_forward(spark, path)
    n = {r.lottery: r["count"] for r in d.groupBy("lottery").count().collect()}
    for lot, size in n.items():
        s0 = max(size - 20, 1) + 1
        for j, cut in enumerate(range(s0, size + 1, 8), 1):
            train = {r.seq for r in BT.training_rows(frame, lot, j).collect()}
            test = {r.seq for r in BT.test_rows(frame, lot, j).collect()}
            assert train == set(range(1, cut - 1))                     # rows whose label comes before the cut-off
            assert test == set(range(cut - 1, min(cut + 8, size + 1) - 1))
    plan = BT.training_rows(frame, "1-URGENT", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lottery" in plan and "blk" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]


def test_boosted_probabilities(spark):
    from drawseries.operators.features import features
    from drawseries.sources import testdata as td
    frame, _ = M.training_frame(features(td.ruled_draws(spark, "/root/testdata/sf0.001"), mode="as_of", block_rows=4096))
    frame = frame.where("lottery = '1-URGENT'")
    models = M.fit_digit_models(frame, M.Candidate(n_estimators=1, max_depth=3, algorithm="gbt", learning_rate=0.3),
                                targets=["y_unidades"])
    out = M.apply_models(frame, models)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan                                        # margins are gathered in the JVM
    rows = out.select("prob_unidades", "pred_unidades", "y_unidades").collect()
    for r in rows:
        assert abs(sum(r.prob_unidades) - 1) < 1e-9 and min(r.prob_unidades) > 0
        assert r.prob_unidades[int(r.pred_unidades)] == max(r.prob_unidades)
    assert sum(r.pred_unidades == r.y_unidades for r in rows) >= 0.9 * len(rows)


def test_candidates_of_both_kinds_are_drawn():
    grid = {"n_estimators": [1, 2], "max_depth": [2], "min_samples_split": [2], "algorithm": ["rf", "gbt"], "learning_rate": [0.3],
            "subsample": [0.5]}
    got = M.draw_candidates(grid, 40, 1)
    assert {c.algorithm for c in got} == {"rf", "gbt"}
    assert all((c.learning_rate, c.subsample) == ((0.3, 0.5) if c.algorithm == "gbt" else (0.1, 1.0)) for c in got)


def test_simulated_stop():
    from drawseries.plans.q_model import simulated_stop
    assert simulated_stop([(0.5, 0.1), (0.5, 0.1), (0.4, 0.1)], 2) == 3
    assert simulated_stop([(0.5, 0.1), (0.5, 0.2), (0.4, 0.1)], 2) is None
    assert simulated_stop([], 2) is None


@pytest.fixture(scope="module")
def stored(spark, learnable, tmp_path_factory):
    """Two series' forests in a registry."""
    from drawseries.operators import registry as RG
    _as_of, frame, _labels = learnable
    both = frame.unionByName(frame.withColumn("lottery", F.lit("Z/2 ñ")).where("seq % 3 > 0"))
    models = {lot: M.fit_per_lottery(both, M.Candidate(n_estimators=4, max_depth=d, seed=5), [lot])[lot]
              for lot, d in (("S", 6), ("Z/2 ñ", 0))}
    root = str(tmp_path_factory.mktemp("registry"))
    rows = [dict(lottery=lot, target=t, accuracy=0.5, model_id=f"{t}{i}") for i, lot in enumerate(models) for t in ("result", "series")]
    parts = {(r["lottery"], r["target"], r["model_id"]): {k: m for k, m in models[r["lottery"]].items()
                                                          if (k == "y_series") == (r["target"] == "series")} for r in rows}
    RG.register_if_better(spark, root, RG.entries(spark, rows), parts)
    return both, models, root


def test_forest_table_scores_as_mllib(spark, stored):
    from drawseries.operators import forest as FO
    from drawseries.operators import registry as RG
    both, models, root = stored
    forests = FO.forests_of(RG.read_registry(spark, root), FO.forest_table(spark, root))
    assert forests.count() == 10
    got = FO.wide_scores(FO.forest_scores(both.select("lottery", "seq", "features"), forests), ["lottery", "seq"])
    want = M.score(both, models)
    cols = ["lottery", "seq", *[f"{c}_{t[2:]}" for t in M.TARGETS for c in ("pred", "prob")]]
    a = {(r[0], r[1]): r[2:] for r in got.select(*cols).collect()}
    b = {(r[0], r[1]): r[2:] for r in want.select(*cols).collect()}
    assert a.keys() == b.keys() and len(a) == both.count()
    assert all(a[k] == b[k] for k in a)


def test_forest_table_plan_does_not_grow_with_series(spark, stored):
    from drawseries.operators import forest as FO
    from drawseries.operators import registry as RG
    from drawseries.session import checkpoint
    both, _models, root = stored
    both = checkpoint(both)
    one = RG.read_registry(spark, root).where("lottery = 'S'")
    table = FO.forest_table(spark, root)
    sizes = []
    for n in (1, 500):
        names = spark.range(n).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("name"))
        many = one.drop("lottery").crossJoin(names).withColumnRenamed("name", "lottery")
        rows = both.where("lottery = 'S' and seq <= 100").drop("lottery").crossJoin(names.withColumnRenamed("name", "lottery")).where(
            "seq % 50 = 0")
        scored = FO.forest_scores(rows, FO.forests_of(many, table))
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan
        sizes.append(len(plan.splitlines()))
        assert scored.count() == rows.count() * 5
    assert sizes[0] == sizes[1]


def test_fits_read_their_series_folder_only(spark, learnable, monkeypatch):
    _as_of, frame, _labels = learnable
    both = frame.unionByName(frame.withColumn("lottery", F.lit("Z/2 ñ")))
    plans = []
    monkeypatch.setattr(M, "fit_targets", lambda df, cand, targets: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or {t: df.count() for t in targets})
    got = M.fit_per_lottery(both, M.Candidate(), ["S", "Z/2 ñ"])
    assert got["S"] == got["Z/2 ñ"] == {t: frame.count() for t in M.TARGETS}
    assert len(plans) == 10 and all("PartitionFilters: [isnotnull(lottery" in p and "Scan ExistingRDD" not in p for p in plans)


def test_forest_table_guards_features_and_missing_models(spark, stored):
    from drawseries.operators import forest as FO
    from drawseries.operators import registry as RG
    both, _models, root = stored
    forests = FO.forests_of(RG.read_registry(spark, root), FO.forest_table(spark, root))
    alone = both.where("seq = 10").withColumn("lottery", F.lit("nobody"))
    assert FO.forest_scores(alone, forests).count() == 0
    assert FO.forest_scores(both.limit(0), forests).count() == 0
    with pytest.raises(Exception, match="expects 41 features"):
        FO.forest_scores(both.where("seq = 10"), forests, n_features=3).collect()


def test_stored_frame_has_the_rows_of_the_plain_frame_in_folders(spark):
    from drawseries.sources import testdata as td
    d = td.draws(spark, "/root/testdata/sf0.001")
    train, latest, labels = M.stored_frame(d, 0.2, 42, block_rows=512)
    plain, plain_labels = M.training_frame(features(d, mode="as_of", block_rows=512))
    cols = ["lottery", "seq", "fecha", "target", "features", *M.TARGETS, "is_test"]
    plain = M.random_split(plain, 0.2, 42)
    assert labels == plain_labels
    assert sorted(map(str, train.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    last = {r.lottery: r.n for r in d.groupBy("lottery").agg(F.max("seq").alias("n")).collect()}
    assert {r.lottery: r.seq for r in latest.collect()} == last
    assert M.split_frame(train, 0.2, 42) is train
    plan = train.filter((F.col("lottery") == "2-HIGH") & ~F.col("is_test"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "is_test" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]


def test_a_search_scores_its_holdout_once(spark, learnable):
    _as_of, frame, _labels = learnable
    got = M.search(frame, [M.Candidate(n_estimators=2, max_depth=2), M.Candidate(n_estimators=3, max_depth=2)], lotteries=["S"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "features" not in plan and sorted(r.candidate for r in got.collect()) == [0, 1]


def test_a_series_rows_are_kept_for_its_fits_and_let_go(spark, learnable, monkeypatch):
    _as_of, frame, _labels = learnable
    seen = []
    monkeypatch.setattr(M, "fit_targets", lambda df, cand, targets: seen.append(df) or {t: df.storageLevel.useMemory for t in targets})
    assert set(M.fit_per_lottery(frame, M.Candidate(), ["S"])["S"].values()) == {True}
    assert len({id(df) for df in seen}) == 1 and not seen[0].storageLevel.useMemory


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from drawseries.plans.registry import HUGE_METHOD, spark_query
    spark.conf.unset(HUGE_METHOD)
    spark_query("last_date")(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(HUGE_METHOD)) <= 8000


def test_a_block_of_the_features_stays_in_a_windows_memory(spark):
    from drawseries.operators.features import MAX_LOOKBACK
    from drawseries.plans.registry import WINDOW_ROWS, spark_query
    spark.conf.unset(WINDOW_ROWS)
    spark_query("last_date")(spark, "/root/testdata/sf0.001")
    # a block, its halo on both sides, and a carried row for each of the 10,000 numbers
    assert int(spark.conf.get(WINDOW_ROWS)) >= M.MODEL_BLOCK_ROWS + MAX_LOOKBACK + 1 + 10_000


def test_a_long_series_is_scored_by_many_tasks(spark, stored, monkeypatch):
    from drawseries.operators import forest as FO
    from drawseries.operators import registry as RG
    monkeypatch.setattr(FO, "PIECE", 20, raising=False)
    both, models, root = stored
    rows = both.where("lottery = 'S'")
    scored = FO.forest_scores(rows, FO.forests_of(RG.read_registry(spark, root), FO.forest_table(spark, root)))
    tasks = scored.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 5 * rows.count()


def test_weights_of_all_refreshes_are_those_of_their_rows(spark):
    from drawseries.operators import backtest as BT
    from drawseries.operators.stats import weight_of, with_balanced_weights
    from drawseries.sources import testdata as td
    path, _labels = BT.walk_forward_store(td.draws(spark, "/root/testdata/sf0.001"), window=20, retrain=8)
    frame = BT.read_walk_forward(spark, path)
    got = BT.refresh_weights(frame, 3)
    assert sorted(got) == sorted((r.lottery, j) for r in frame.select("lottery").distinct().collect() for j in (1, 2, 3))
    for lot, j in list(got)[:4]:
        train = with_balanced_weights(BT.training_rows(frame, lot, j), M.TARGETS, key="lottery")
        pairs = F.create_map(*[F.lit(x) for pair in got[lot, j].items() for x in pair])
        off = [F.max(F.abs(F.col(f"w_{t}") - weight_of(pairs, t))) for t in M.TARGETS]
        assert set(train.agg(*off).first()) == {0.0}


def test_a_backtests_refreshes_share_the_rows_of_a_series(spark, monkeypatch):
    from drawseries.operators import backtest as BT
    from drawseries.sources import testdata as td
    kept = []
    d = td.draws(spark, "/root/testdata/sf0.001").where("lottery in ('1-URGENT', '2-HIGH')")
    real = type(d).persist
    monkeypatch.setattr(type(d), "persist", lambda df, *a: kept.append(df) or real(df, *a))
    got = BT.backtest_model(d, M.Candidate(n_estimators=2, max_depth=2), window=20, retrain=8)
    assert got.count() == 40 and len(kept) == 2          # two series of three refreshes
    assert not any(df.storageLevel.useMemory for df in kept)
