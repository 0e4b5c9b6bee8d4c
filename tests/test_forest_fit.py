"""Forests grown on binned rows: splits and trees against plain restatements, bags, limits, independence of partitions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from drawseries.operators import forest_fit as FF
from drawseries.operators import model as M

TARGET = ["y_a"]


def _rows(spark, n=400, seed=3, blk=lambda i: 0):
    """Rows of 41 features: the label follows from the first two, one feature is constant and one has two values."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 41)).round(3)
    x[:, 5], x[:, 6] = 1.0, rng.integers(0, 2, n)
    y = (x[:, 0] > 0.2) * 1.0 + (x[:, 1] > -0.1) * 1.0
    data = [("S", i + 1, blk(i), None if i == 7 else float(y[i]), Vectors.dense(x[i])) for i in range(n)]
    df = spark.createDataFrame(data, ["lottery", "seq", "blk", "y_a", "features"])
    return df.withColumn("blk", F.col("blk").cast("int")), x, y


def _grown(df, plans):
    edges = FF.split_candidates(df)
    return FF.fit_series(FF.binned_rows(df, TARGET, edges), edges, {"S": plans})["S"], edges["S"]


def test_best_split_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 4, (3, 2, FF.BINS, 3)).astype(float)
    cells[1:] = 0                                        # other features: the same rows in one bin each
    cells[1:, :, 0] = cells[0].sum(axis=1)
    w = np.array([1.0, 2.0, 0.5])
    gain, j, b, left, right = FF.best_splits(cells, w, 2)

    def gini(c):
        return 1 - ((c * w) ** 2).sum() / (c * w).sum() ** 2
    for node in range(2):
        total, best = cells[0, node].sum(axis=0), -1
        for at in range(FF.BINS - 1):
            lo = cells[0, node, :at + 1].sum(axis=0)
            hi = total - lo
            if min(lo.sum(), hi.sum()) >= 2:
                share = (lo * w).sum() / (total * w).sum()
                best = max(best, gini(total) - share * gini(lo) - (1 - share) * gini(hi))
        assert gain[node] == pytest.approx(best) and j[node] == 0
        assert (left[node] + right[node] == total).all()


def test_one_tree_is_the_tree_of_all_rows(spark):
    """Without bags and with all features the tree is the greedy one; it is MLlib's too."""
    from pyspark.ml.classification import RandomForestClassifier
    df, x, y = _rows(spark)
    (forest,), _ = _grown(df, [FF.Plan(0, np.ones(3), 1, 3, 1, 42)])
    keep = np.arange(len(y)) != 7
    got = forest.probabilities(x[keep])
    assert np.allclose(got.sum(axis=1), 1) and (got.argmax(axis=1) == y[keep]).mean() > 0.97
    m = RandomForestClassifier(labelCol="y_a", numTrees=1, maxDepth=3, seed=42, bootstrap=False).fit(df.where("y_a is not null"))
    same = [r.prediction for r in m.transform(df.where("y_a is not null")).orderBy("seq").collect()]
    assert (got.argmax(axis=1) == np.array(same)).mean() > 0.97
    assert len(forest.feature) >= 5 and forest.getNumTrees == 1 and forest.numFeatures == 41


def test_forests_do_not_depend_on_partitions(spark):
    df, x, _y = _rows(spark)
    plan = FF.Plan(0, np.array([1.0, 0.5, 2.0]), 4, 4, 1, 9)
    edges = FF.split_candidates(df)
    forests = [FF.fit_series(FF.binned_rows(df.repartition(n), TARGET, edges), edges, {"S": [plan]})["S"][0] for n in (1, 5)]
    assert (forests[0].probabilities(x) == forests[1].probabilities(x)).all()


def test_a_refresh_sees_the_blocks_below_it_only(spark):
    df, x, _y = _rows(spark, blk=lambda i: i // 200)
    other = df.withColumn("y_a", F.when(F.col("blk") > 0, 2.0 - F.col("y_a")).otherwise(F.col("y_a")))
    plans = [FF.Plan(0, np.ones(3), 3, 3, 1, 5, limit=j) for j in (1, 2)]
    edges = FF.split_candidates(df.where("blk = 0"))
    a, b = [FF.fit_series(FF.binned_rows(d, TARGET, edges), edges, {"S": plans})["S"] for d in (df, other)]
    assert (a[0].probabilities(x) == b[0].probabilities(x)).all()
    assert (a[1].probabilities(x) != b[1].probabilities(x)).any()


def test_a_pass_of_few_counts_gives_the_same_forest(spark, monkeypatch):
    df, x, _y = _rows(spark)
    plans = [FF.Plan(0, np.ones(3), 3, 5, 1, 5), FF.Plan(0, np.ones(3), 2, 2, 1, 6)]
    whole, _ = _grown(df, plans)
    monkeypatch.setattr(FF, "PASS_CELLS", 1)             # one tree a pass
    parts, _ = _grown(df, plans)
    for a, b in zip(whole, parts):
        assert (a.probabilities(x) == b.probabilities(x)).all()


def test_bags_are_poisson():
    w = FF.bag_weights(np.arange(200_000), 42, 3).astype(float)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    other = FF.bag_weights(np.arange(200_000), 42, 4).astype(float)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.02
    assert FF.bag_weights(np.arange(50_000), -7, 0).max() > 3


def test_few_values_are_split_between_all_of_them_and_many_at_quantiles():
    assert FF._thresholds(np.array([3.0, 1.0, 2.0, 1.0]), np.ones(4)).tolist() == [1.5, 2.5]
    assert FF._thresholds(np.array([1.0]), np.ones(1)).tolist() == []
    many = FF._thresholds(np.arange(10_000.0), np.ones(10_000))
    assert len(many) == FF.BINS - 1 and np.ptp(np.diff(many)) <= 2


def test_a_search_grows_the_forests_of_all_candidates_together(spark, monkeypatch):
    """Neither a fit per candidate and target nor a pass per candidate."""
    df, _x, _y = _rows(spark, 300)
    frame = df.drop("blk").select("lottery", "seq", "features", *[F.coalesce("y_a", F.lit(0.0)).alias(t) for t in M.TARGETS])
    monkeypatch.setattr(M, "fit_targets", lambda *a: pytest.fail("a fit of its own"))
    grown, real = [], FF.grow_forests
    monkeypatch.setattr(FF, "grow_forests", lambda rows, plans, edges: grown.append(len(plans)) or real(rows, plans, edges))
    got = M.search(frame, [M.Candidate(n_estimators=15, max_depth=d, seed=4) for d in (4, 5)], lotteries=["S"]).collect()
    assert grown == [10] and sorted(r.candidate for r in got) == [0, 1]
    assert all(r.n > 0 and r.series_acc > 0.5 for r in got)
