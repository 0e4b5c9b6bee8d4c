import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawseries.llm import whitening as W
from drawseries.llm.queries import QUERIES

from ..conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(rows, components=32):
    """numpy's eigenvectors of the covariance of whole numbers, and exact deviations."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[(n * c - t) / n for c, t in zip(v, s)] for v in x])
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    return [i for i, _ in rows], dev, z @ (q / np.sqrt(e)), e / np.trace(cov), n


def check(got, rows, components=32):
    ids, dev, white, share, n = brute(rows, components)
    k = len(share)
    assert len(got) == len(ids) * k
    mine = np.zeros((len(ids), k))
    at = {i: r for r, i in enumerate(ids)}
    for r in got:
        assert r.n == n and r.deviation == dev[at[r.vec_id]] and r.identity_error <= 1e-4
        assert abs(r.explained - share[r.component - 1]) <= 1e-4 * share[r.component - 1]
        mine[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-6
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-4


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10 ** 6), st.booleans())
def test_inertia_counts_and_leading_pairs(d, seed, repeated):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(rng.integers(1, 4, d).astype(float) if repeated else rng.uniform(0.1, 5, d))[::-1]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for s in rng.uniform(-1, 6, 5):
        if np.abs(e - s).min() > 1e-9:
            assert W.inertia(v - s * np.eye(d)) == (e > s).sum()
    got, x = W.leading(v, 5)
    assert np.allclose(got, e[:5], rtol=1e-10) and np.allclose(x.T @ x, np.eye(len(got)), atol=1e-10)
    assert np.allclose(v @ x, x * got, atol=1e-9)


def test_inertia_takes_zero_pivots():
    assert W.inertia(np.array([[0.0, 1], [1, 0]])) == 1
    assert W.inertia(np.array([[0.0, 1, 0], [1, 0, 2], [0, 2, 0]])) == 1
    assert W.inertia(np.zeros((3, 3))) == 0


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for bits in (5, 30, 46):
        z = rng.integers(-2 ** bits, 2 ** bits, (5000, 3))
        o = z.astype(object)
        assert W.exact_products(z) == (o.T @ o)[np.triu_indices(3)].tolist()


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [5, 4, 3, 2, 1, .5]).astype(np.float32).tolist()) for i in range(80)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (103, [math.nan] + [0.0] * 5), (104, [math.inf] + [0.0] * 5),
           (105, [1.0, 2.0]), (106, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], SCHEMA).repartition(5)
    check(W.whiten(df).collect(), rows + [(106, [0.0] * 6)])
    check(W.whiten(df, components=2).collect(), rows + [(106, [0.0] * 6)], 2)


def test_few_rows_and_no_variance(spark):
    def of(rows):
        return W.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)).collect()
    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [1.0, 2.0])]) == [] and of([(1, [1.0]), (2, [1.0])]) == []
    got = of([(1, [0.0, 5.0]), (1, [1.0, 5.0]), (None, [2.0, 5.0])])      # one dimension varies; ids repeat or are null
    assert {r.component for r in got} == {1} and len(got) == 3 and all(r.explained == 1 for r in got)
    assert sorted(r.deviation for r in got) == [0, 192 ** 2, 192 ** 2]


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0 ** 36 + 2 ** 20 * i, -2.0 ** 38 * (i % 3)]) for i in range(6)]
    ids, dev, *_ = brute(rows)
    got = W.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)).collect()
    want = {i: d if d < 1 << 63 else None for i, d in zip(ids, dev)}
    assert {r.vec_id: r.deviation for r in got} == want
    ids, dev, *_ = brute([(i, [1e6 * i, 0.0]) for i in range(3)])
    got = W.whiten(spark.createDataFrame([(i, [1e6 * i, 0.0], "") for i in range(3)], SCHEMA)).collect()
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == dev


def test_uncertified_numbering_is_refused(monkeypatch):
    monkeypatch.setattr(W, "_eigenvectors", lambda a, low, high, n, found: ([0.1] * n, np.eye(len(a))[:, :n]))
    with pytest.raises(ArithmeticError):
        W.leading(np.diag([3.0, 2.0, 1.0]), 2)


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_spectrum_whitening"](spark, SF_SMALL).collect(), rows)
