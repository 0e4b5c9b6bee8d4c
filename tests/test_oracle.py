"""Every registered query equals its DuckDB oracle (sf0.001, sorted rows)."""

import pytest

from drawseries import plans  # noqa: F401
from drawseries.plans.check import compare
from drawseries.plans.registry import REGISTRY

from .conftest import SF_SMALL

# the other model queries fit dozens of forests each; plans.check compares them too
FITS = {"ml_rule_accuracy", "ml_warm_start", "search_history", "backtest_rf", "backtest_rf_metrics", "predict_from_registry",
        "ml_search", "ml_select_best", "ml_top3_signs", "ml_prediction_log", "ml_feature_importance", "ml_register_models",
        "ml_score_dates", "ml_boosted_candidate", "model_alerts"}
WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql and n not in FITS)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, SF_SMALL, name)
    assert r["match"], r


def test_every_query_has_spec_and_builds(spark):
    for name, q in REGISTRY.items():
        assert q.spec, name
