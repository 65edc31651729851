"""Queries over the sample tables, one module per area."""

import importlib

_MODULES = ["flow_queries", "decision_queries", "training_queries", "evaluation_queries", "model_queries", "stream_queries", "capture_queries"]


def all_queries():
    """(name -> callable(spark, sf_dir), name -> checking SQL)."""
    for module in _MODULES:
        importlib.import_module(f"wirelark.plans.{module}")
    from wirelark.plans import catalog
    return catalog.QUERIES, catalog.ORACLES
