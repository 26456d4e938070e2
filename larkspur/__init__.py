"""larkspur: a PySpark-native analytics engine.

A typed session, DataFrame, expression and SQL interface whose planning and
execution are Spark's. Names are imported when first used.
"""

from __future__ import annotations

import importlib

_HOME = {
    "larkspur.expr": ["Expr", "WindowFrame", "aggregate", "case", "col", "function", "lit"],
    "larkspur.frame": ["DataFrame"],
    "larkspur.plans": ["ContextProvider", "LogicalPlan", "LogicalPlanBuilder", "OptimizationRule", "OptimizerContext", "optimize_plan", "parse_sql", "table_scan", "table_scan_with_filters"],
    "larkspur.session": ["SessionConfig", "SessionContext", "SessionState", "Table"],
    "larkspur.sources.python_sources": ["AbstractTableProvider"],
    "larkspur.userfunctions": ["Accumulator", "AggregateUDF", "ScalarUDF", "WindowEvaluator", "WindowUDF", "udaf", "udf", "udwf"],
}
_ALIASES = {"OptimizerRule": "OptimizationRule", "TableProvider": "AbstractTableProvider"}
__all__ = sorted([*(n for names in _HOME.values() for n in names), *_ALIASES])


def __getattr__(name: str):
    real = _ALIASES.get(name, name)
    for module, names in _HOME.items():
        if real in names:
            return getattr(importlib.import_module(module), real)
    raise AttributeError(f"module 'larkspur' has no attribute {name!r}")
