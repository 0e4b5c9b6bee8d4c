"""Registered queries.  Importing this package registers all of them."""

from . import q_backtest, q_catalog, q_clean, q_features, q_model, q_stats, q_stream  # noqa: F401
from .registry import REGISTRY, oracle, spark_query  # noqa: F401
