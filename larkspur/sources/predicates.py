"""Filters that a Python source can apply itself, translated for pyarrow and for foreign expressions.

Spark offers each filter of a scan; a source takes those it translates in full
(Spark then drops them) and leaves the others to Spark.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import datasource as ds

_COMPARE: dict[type, Callable] = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}
_LITERALS = (bool, int, float, str)


class Unsupported(ValueError):
    pass


def _name(f: Any) -> str:
    if len(f.attribute) != 1:
        raise Unsupported("a nested column")
    return f.attribute[0]


def _value(v: Any) -> Any:
    if not isinstance(v, _LITERALS):
        raise Unsupported(f"a literal {v!r}")
    return v


def to_arrow(f: ds.Filter) -> pc.Expression:
    """The filter as a pyarrow dataset expression."""
    if isinstance(f, ds.Not):
        inner = to_arrow(f.child)
        return pc.field(_name(f.child)).is_valid() & ~inner if isinstance(f.child, ds.In) else ~inner  # a null is never "not in"
    field = pc.field(_name(f))
    if type(f) in _COMPARE:
        return _COMPARE[type(f)](field, pc.scalar(_value(f.value)))
    if isinstance(f, ds.IsNull):
        return field.is_null()
    if isinstance(f, ds.IsNotNull):
        return field.is_valid()
    if isinstance(f, ds.In):
        return field.isin(pa.array([_value(v) for v in f.value]))
    raise Unsupported(type(f).__name__)


def to_foreign(f: ds.Filter, table: Any) -> Any:
    """The filter on a deferred table's own column expressions."""
    if isinstance(f, ds.Not):
        if isinstance(f.child, ds.In):
            return table[_name(f.child)].notin([_value(v) for v in f.child.value])
        return ~to_foreign(f.child, table)
    column = table[_name(f)]
    if type(f) in _COMPARE:
        return _COMPARE[type(f)](column, _value(f.value))
    if isinstance(f, ds.IsNull):
        return column.isnull()
    if isinstance(f, ds.IsNotNull):
        return column.notnull()
    if isinstance(f, ds.In):
        return column.isin([_value(v) for v in f.value])
    raise Unsupported(type(f).__name__)


def split(filters: list[ds.Filter], translate: Callable[[ds.Filter], Any]) -> tuple[list[Any], list[ds.Filter]]:
    """Translated filters, and those left to Spark."""
    taken, left = [], []
    for f in filters:
        try:
            taken.append(translate(f))
        except Unsupported:
            left.append(f)
    return taken, left
