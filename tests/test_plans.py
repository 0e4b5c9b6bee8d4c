"""Physical-plan guards: JVM-side expressions only, predicates in the scan,
top-k limited before the shuffle, size-checked dimension broadcasts."""

import pytest

from drawseries import plans  # noqa: F401
from drawseries.plans.registry import REGISTRY

from .conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                "MapInPandas", "AggregateInPandas")


def _plan(spark, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if not n.startswith(("ml_", "backtest_rf", "predict_from", "model_alerts"))))
def test_no_python_in_plan(spark, name):
    plan = _plan(spark, name)
    assert not any(node in plan for node in PYTHON_NODES), name


def test_feature_rows_are_not_gathered_in_one_task(spark):
    """The newest rows that models predict from keep the partitions of the feature stage."""
    from drawseries.plans import q_model
    _train, latest, _labels = q_model._frame(spark, SF_SMALL)
    assert "Coalesce 1" not in latest._jdf.queryExecution().executedPlan().toString()
    assert latest.rdd.getNumPartitions() > 1


def test_draws_grow_with_the_orders(spark):
    from drawseries.sources import testdata as td
    mid, large = [td.raw_draws(spark, f"/root/testdata/{sf}").select("fecha", "lottery").distinct().count()
                  for sf in ("sf0.01", "sf0.1")]
    assert 8 * mid <= large <= 12 * mid


@pytest.mark.parametrize("name", ["acf", "lag_corr", "digit_corr"])
def test_statistics_attach_nothing_by_a_hot_key(spark, name):
    from drawseries.operators import stats
    from drawseries.sources import testdata as td
    plan = getattr(stats, name)(td.draws(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_lottery_predicate_prunes_partitions(spark):
    assert "PartitionFilters: [isnotnull(lottery" in _plan(spark, "read_draws")
    assert "PartitionFilters" in _plan(spark, "lottery_eq")


def test_date_predicate_pushed_to_parquet(spark):
    plan = _plan(spark, "between_dates")
    assert "PushedFilters: [IsNotNull(fecha), GreaterThanOrEqual(fecha,1996-03-01)" in plan


def test_top_k_limits_before_shuffle(spark):
    plan = _plan(spark, "last_n")
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) and final


def test_small_dimensions_are_broadcast(spark):
    assert "BroadcastHashJoin" in _plan(spark, "v_resultados")
