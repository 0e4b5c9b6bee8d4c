"""One-vs-rest boosted trees on binned rows: MLlib's trees, splits by brute force, independence of partitions, whole rounds."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from drawseries.operators import boosted_fit as BF
from drawseries.operators import forest_fit as FF
from drawseries.operators import model as M


@pytest.fixture(scope="module")
def frame(spark):
    """Two series of 41 features; each feature has at most 20 values, so that both libraries try the same splits."""
    rng = np.random.default_rng(4)
    data = []
    for lot in ("S", "Z"):
        x = rng.integers(0, 20, (240, 41)).astype(float)
        y = (x[:, 3] > 8) * 1.0 + (x[:, 9] + x[:, 11] > 20)
        data += [(lot, i + 1, *[float(y[i])] * 4, float(x[i, 5] > 15), Vectors.dense(x[i])) for i in range(240)]
    return spark.createDataFrame(data, ["lottery", "seq", *M.TARGETS, "features"]).cache()


def _cand(rounds, **more):
    return M.Candidate(n_estimators=rounds, max_depth=3, algorithm="gbt", learning_rate=0.3, seed=1, **more)


def _probs(df, models, cols=("prob_miles", "prob_series")):
    return [np.array(c) for c in zip(*[[r[c] for c in cols] for r in M.apply_models(df, models).orderBy("seq").collect()])]


def test_the_trees_are_those_of_mllib(frame):
    mine = frame.where("lottery = 'S'")
    own = M.fit_per_lottery(frame, _cand(3), ["S"])["S"]
    theirs = M.fit_targets(mine, _cand(3), ["y_miles", "y_series"])
    for a, b in zip(_probs(mine, own), _probs(mine, theirs)):
        assert a.shape == b.shape and np.allclose(a.sum(axis=1), 1)
        assert np.abs(a - b).mean() < 1e-3 and (a.argmax(axis=1) == b.argmax(axis=1)).mean() > 0.99


def test_every_round_is_grown_past_the_stored_margins_and_lowers_the_loss(frame):
    """More rounds than ``KEEP``: margins are stored and read back between them."""
    mine = frame.where("lottery = 'Z'")
    y = [int(r.y_miles) for r in mine.orderBy("seq").collect()]
    losses = []
    for rounds in (1, 4, 2 * BF.KEEP + 1):
        m = M.fit_per_lottery(frame, _cand(rounds), ["S", "Z"])["Z"]
        assert {x.rounds for x in m.values()} == {rounds} and set(m) == set(M.TARGETS)
        losses.append(-np.log(_probs(mine, m)[0][np.arange(len(y)), y]).mean())
    assert losses[0] > losses[1] > losses[2]


def test_a_fit_does_not_depend_on_partitions(frame, monkeypatch):
    monkeypatch.setattr(FF, "TASK_ROWS", 50)
    got = [M.fit_per_lottery(frame.repartition(n), _cand(BF.KEEP + 1, subsample=0.7), ["S", "Z"]) for n in (1, 4)]
    for lot in ("S", "Z"):
        for a, b in zip(*[_probs(frame.where(F.col("lottery") == lot), g[lot]) for g in got]):
            assert (a == b).all()


def test_best_split_is_that_of_all_pairs():
    rng = np.random.default_rng(2)
    rows, r = rng.integers(0, 3, (2, 1, FF.BINS)), rng.normal(size=(2, 1, FF.BINS)).round(2)
    rows[1] = 0
    rows[1, 0, 4] = rows[0].sum()
    steps = np.rint(r * rows * BF.STEPS)
    steps[1] = 0
    steps[1, 0, 4] = steps[0].sum()
    gain, f, b, own, left, right = BF.best_splits(steps, rows, 1)
    s, n = steps[0, 0] / BF.STEPS, rows[0, 0]
    best = max((s[:i].sum() ** 2 / n[:i].sum() + s[i:].sum() ** 2 / n[i:].sum() - s.sum() ** 2 / n.sum()) / n.sum()
               for i in range(1, FF.BINS) if n[:i].sum() and n[i:].sum())
    assert gain[0] == pytest.approx(best) and f[0] == 0 and own[0] == pytest.approx(s.sum() / n.sum())
    at = int(b[0]) + 1
    assert left[0] == pytest.approx(s[:at].sum() / n[:at].sum()) and right[0] == pytest.approx(s[at:].sum() / n[at:].sum())


def test_the_boosted_query_does_the_rounds_of_a_boosted_candidate():
    """The reference draws 50 to 300 rounds; one round was left of them."""
    from drawseries.plans import q_model
    cand = M.draw_candidates(q_model.BOOSTED, 1, rng_seed=1)[0]
    assert cand.algorithm == "gbt" and cand.n_estimators >= 50
