"""User-defined scalar, aggregate and window functions over Arrow arrays."""

from __future__ import annotations

import bisect
import copy
import functools
from abc import ABCMeta, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.expr import Expr, SortExpr, WindowFrame, _expr
from larkspur.types import _carrier, to_spark

VOLATILITIES = ("immutable", "stable", "volatile")


def _volatility(name: str) -> str:
    if str(name).lower() not in VOLATILITIES:
        raise ValueError(f"volatility is immutable, stable or volatile, not {name!r}")
    return str(name).lower()


def _cast(got: Any, kind: pa.DataType) -> pa.Array:
    array = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    return array.cast(_carrier(kind))


class Accumulator(metaclass=ABCMeta):
    """The state of one group of a user-defined aggregate."""

    @abstractmethod
    def state(self) -> list[pa.Scalar]: ...

    @abstractmethod
    def update(self, *values: pa.Array) -> None: ...

    @abstractmethod
    def merge(self, states: pa.Array) -> None: ...

    @abstractmethod
    def evaluate(self) -> pa.Scalar: ...


class WindowEvaluator:
    """A user-defined window function; which method is called follows from the flags."""

    def memoize(self) -> None:
        """Called once a row in bounded execution."""

    def get_range(self, idx: int, num_rows: int) -> tuple[int, int]:
        return idx, idx + 1

    def is_causal(self) -> bool:
        return False

    def evaluate_all(self, values: list[pa.Array], num_rows: int) -> pa.Array:
        raise NotImplementedError

    def evaluate(self, values: list[pa.Array], eval_range: tuple[int, int]) -> pa.Scalar:
        raise NotImplementedError

    def evaluate_all_with_rank(self, num_rows: int, ranks_in_partition: list[tuple[int, int]]) -> pa.Array:
        raise NotImplementedError

    def supports_bounded_execution(self) -> bool:
        return False

    def uses_window_frame(self) -> bool:
        return False

    def include_rank(self) -> bool:
        return False


@dataclass(eq=False, repr=False)
class UdfCall(Expr):
    udf: Any
    args: list[Expr]

    def children(self) -> list[Expr]:
        return self.args

    def to_column(self):
        return self.udf.spark()(*(a.to_column() for a in self.args))

    def canonical_name(self) -> str:
        return f"{self.udf.name}({', '.join(a.canonical_name() for a in self.args)})"


class ScalarUDF:
    """``func(*arrays) -> array``, once a batch."""

    def __init__(self, name: str, func: Callable, input_types: list[pa.DataType], return_type: pa.DataType, volatility: str):
        self.name, self.func, self.input_types, self.return_type, self.volatility = name, func, list(input_types), return_type, _volatility(volatility)

    def spark(self):
        func, kind = self.func, self.return_type

        def run(*arrays: pa.Array) -> pa.Array:
            return _cast(func(*arrays), kind)

        # Arrow functions are told scalar or aggregate by their annotations.
        n = len(self.input_types)
        source = f"def call({', '.join(f'a{i}: pa.Array' for i in range(n))}) -> pa.Array:\n    return run({', '.join(f'a{i}' for i in range(n))})"
        scope: dict[str, Any] = {"pa": pa, "run": run}
        exec(source, scope)
        out = F.arrow_udf(scope["call"], to_spark(kind))
        return out.asNondeterministic() if self.volatility == "volatile" else out

    def __call__(self, *args: Any) -> UdfCall:
        return UdfCall(self, [_expr(a) for a in args])

    def register(self, spark: SparkSession) -> None:
        spark.udf.register(self.name, self.spark())

    def __repr__(self) -> str:
        return f"ScalarUDF({self.name})"


class AggregateUDF:
    """An accumulator class. In SQL and over frames a group is one update; :meth:`aggregate` works in two phases."""

    def __init__(self, name: str, accumulator: type[Accumulator], input_type: Any, return_type: pa.DataType, state_type: list[pa.DataType], volatility: str):
        self.name, self.accumulator, self.return_type, self.volatility = name, accumulator, return_type, _volatility(volatility)
        self.input_types = [input_type] if isinstance(input_type, pa.DataType) else list(input_type)
        self.state_type = [state_type] if isinstance(state_type, pa.DataType) else list(state_type)

    def spark(self):
        make, kind = self.accumulator, self.return_type

        def run(*arrays: pa.Array) -> Any:
            acc = make()
            acc.update(*arrays)
            got = acc.evaluate()
            return got.as_py() if isinstance(got, pa.Scalar) else got

        n = len(self.input_types)
        source = f"def call({', '.join(f'a{i}: pa.Array' for i in range(n))}) -> float:\n    return run({', '.join(f'a{i}' for i in range(n))})"
        scope: dict[str, Any] = {"pa": pa, "run": run}
        exec(source, scope)
        return F.arrow_udf(scope["call"], to_spark(kind))

    def __call__(self, *args: Any) -> UdfCall:
        return UdfCall(self, [_expr(a) for a in args])

    def register(self, spark: SparkSession) -> None:
        spark.udf.register(self.name, self.spark())

    def aggregate(self, df: SparkDataFrame, keys: list[str], args: list[str], alias: str) -> SparkDataFrame:
        """groupBy(keys) with a partial state for each task and key, then merge and evaluate: only states are shuffled.

        ``merge`` gets the first state column of all partial states as one array.
        """
        make, kinds, kind, most = self.accumulator, self.state_type, self.return_type, 100_000
        fields = [df.schema[k] for k in keys]
        schema = T.StructType([*fields, *(T.StructField(f"__s{i}", to_spark(t)) for i, t in enumerate(kinds))])

        def partial(batches):
            held: dict[tuple, Accumulator] = {}
            kept: pa.Schema | None = None

            def states() -> pa.RecordBatch:
                rows = [[s.as_py() if isinstance(s, pa.Scalar) else s for s in acc.state()] for acc in held.values()]
                columns = [pa.array(list(c), kept.field(n).type) for n, c in zip(keys, zip(*held))]
                columns += [pa.array([r[i] for r in rows], _carrier(t)) for i, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, [*keys, *(f"__s{i}" for i in range(len(kinds)))])

            for batch in batches:
                table = pa.Table.from_batches([batch])
                kept = kept or table.select(keys).schema
                if keys:
                    table = table.append_column("__i", pa.array(np.arange(table.num_rows)))
                    groups = table.group_by(keys).aggregate([("__i", "list")])
                    coded = zip(zip(*(groups.column(k).to_pylist() for k in keys)), groups.column("__i_list").combine_chunks())
                else:
                    coded = [((), None)] if table.num_rows else []
                for k, at in coded:
                    acc = held.setdefault(k, make())
                    some = table if at is None else table.take(at.values)
                    acc.update(*(some.column(a).combine_chunks() for a in args))
                if len(held) >= most:  # states of many keys go on at once; they are merged later all the same
                    yield states()
                    held.clear()
            if held:
                yield states()

        def final(table: pa.Table) -> pa.Table:
            acc = make()
            acc.merge(table.column("__s0").combine_chunks())
            got = acc.evaluate()
            columns = {k: table.column(k).slice(0, 1) for k in keys}
            return pa.table({**columns, alias: pa.array([got.as_py() if isinstance(got, pa.Scalar) else got], _carrier(kind))})

        out = T.StructType([*fields, T.StructField(alias, to_spark(kind))])
        return df.select(*keys, *(a for a in args if a not in keys)).mapInArrow(partial, schema).groupBy(*keys).applyInArrow(final, out)

    def __repr__(self) -> str:
        return f"AggregateUDF({self.name})"


@dataclass(eq=False, repr=False)
class WindowCall(Expr):
    """A window function's call; ``over`` says on what window, and ``apply`` appends the result to a frame."""

    udf: "WindowUDF"
    args: list[Expr]
    partition_by: list[Expr] = field(default_factory=list)
    order_by: list[Expr] = field(default_factory=list)
    frame: WindowFrame | None = None

    def children(self) -> list[Expr]:
        return self.args

    def over(self, partition_by: list[Expr] | None = None, order_by: list[Expr] | None = None, frame: WindowFrame | None = None) -> "WindowCall":
        return WindowCall(self.udf, self.args, list(partition_by or []), list(order_by or []), frame)

    def canonical_name(self) -> str:
        return f"{self.udf.name}({', '.join(a.canonical_name() for a in self.args)})"

    def apply(self, df: SparkDataFrame, alias: str) -> SparkDataFrame:
        return self.udf.append(df, self, alias)


def _bounds(frame: WindowFrame | None, ordered: bool, n: int, peers: list[tuple[int, int]], keys: list[Any], rising: bool = True) -> list[tuple[int, int]]:
    """The rows [start, stop) of each row's frame; by default up to the last peer, or all rows without an order."""
    group = [g for g, (a, b) in enumerate(peers) for _ in range(a, b)]
    if frame is None:
        return [(0, peers[group[i]][1]) if ordered else (0, n) for i in range(n)]
    units, lo, hi = frame.units.lower(), frame.start, frame.end
    if units == "rows":
        return [(0 if lo is None else max(0, i - lo), n if hi is None else max(0, min(n, i + hi + 1))) for i in range(n)]
    if units == "groups":
        return [(0 if lo is None else peers[max(0, group[i] - lo)][0], n if hi is None else peers[min(len(peers) - 1, group[i] + hi)][1]) for i in range(n)]
    # The sorted keys between the nulls at either end; falling ones are searched as their negatives.
    first = next((i for i in range(n) if keys[i] is not None), n)
    last = next((i for i in range(n, first, -1) if keys[i - 1] is not None), first)
    at = (lambda i: keys[i]) if rising else (lambda i: _Falling(keys[i]))
    out = []
    for i in range(n):
        v = keys[i]
        if v is None or lo is None and hi is None:
            out.append((0 if lo is None else peers[group[i]][0], n if hi is None else peers[group[i]][1]))
            continue
        low = (lambda: v - lo) if rising else (lambda: _Falling(v + lo))
        high = (lambda: v + hi) if rising else (lambda: _Falling(v - hi))
        start = 0 if lo is None else bisect.bisect_left(range(n), low(), first, last, key=at)
        out.append((start, n if hi is None else bisect.bisect_right(range(n), high(), first, last, key=at)))
    return out


@functools.total_ordering
class _Falling:
    """A value that sorts the other way round."""

    def __init__(self, value: Any):
        self.value = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Falling) and self.value == other.value

    def __lt__(self, other: "_Falling") -> bool:
        return other.value < self.value


def _changes(columns: list[pa.ChunkedArray], n: int) -> list[int]:
    """The rows that differ from the one before, the first included."""
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        change |= other.to_numpy() if isinstance(other, pa.ChunkedArray) else other.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist()]


class WindowUDF:
    """A window function from an evaluator instance, of which each window partition has a copy."""

    def __init__(self, name: str, func: WindowEvaluator, input_types: list[pa.DataType], return_type: pa.DataType, volatility: str):
        self.name, self.func, self.input_types, self.return_type, self.volatility = name, func, list(input_types), return_type, _volatility(volatility)

    def __call__(self, *args: Any) -> WindowCall:
        return WindowCall(self, [_expr(a) for a in args])

    def append(self, df: SparkDataFrame, call: WindowCall, alias: str) -> SparkDataFrame:
        """df with the function's values as a column; each window partition is sorted and evaluated in one task."""
        evaluator, kind, frame = self.func, self.return_type, call.frame
        names = df.columns
        orders = [o if isinstance(o, SortExpr) else SortExpr(o, True, True) for o in call.order_by]
        parts = [f"__p{i}" for i in range(len(call.partition_by))]
        keys = [f"__o{i}" for i in range(len(orders))]
        args = [f"__a{i}" for i in range(len(call.args))]
        wide = df.select(
            "*", *(p.to_column().alias(n) for p, n in zip(call.partition_by, parts)), *(o.over.to_column().alias(n) for o, n in zip(orders, keys)), *(a.to_column().alias(n) for a, n in zip(call.args, args))
        )
        sort_keys = [(n, o.asc, o.first) for n, o in zip(keys, orders)]

        def run(table: pa.Table) -> pa.Table:
            order = []
            for name, asc, first in sort_keys:  # a key's nulls stand where it says
                table = table.append_column(f"{name}n", pc.is_null(table.column(name)))
                order += [(f"{name}n", "descending" if first else "ascending"), (name, "ascending" if asc else "descending")]
            if order:
                table = table.take(pc.sort_indices(table, sort_keys=order))
            n = table.num_rows
            held = [table.column(keys[0]).to_pylist()] if keys and frame is not None and frame.units.lower() == "range" else []
            starts = _changes([table.column(k) for k in keys], n)
            peers = list(zip(starts, [*starts[1:], n]))
            values = [table.column(a).combine_chunks() for a in args]
            own = copy.deepcopy(evaluator)
            if own.uses_window_frame():
                scalars = [own.evaluate(values, b) for b in _bounds(frame, bool(keys), n, peers, held[0] if held else [None] * n, not sort_keys or sort_keys[0][1])]
            elif own.supports_bounded_execution():
                scalars = []
                for i in range(n):
                    got = own.get_range(i, n)
                    if not isinstance(got, tuple) or len(got) != 2:
                        raise ValueError(f"get_range has to give (start, stop), not {got!r}")
                    scalars.append(own.evaluate(values, got))
                    own.memoize()
            elif own.include_rank():
                scalars = own.evaluate_all_with_rank(n, peers)
            else:
                scalars = own.evaluate_all(values, n)
            if isinstance(scalars, list):
                scalars = pa.array([s.as_py() if isinstance(s, pa.Scalar) else s for s in scalars], _carrier(kind))
            return table.select(names).append_column(alias, _cast(scalars, kind))

        schema = T.StructType([*df.schema.fields, T.StructField(alias, to_spark(kind))])
        return wide.groupBy(*parts).applyInArrow(run, schema)

    def __repr__(self) -> str:
        return f"WindowUDF({self.name})"


def udf(func: Callable, input_types: list[pa.DataType], return_type: pa.DataType, volatility: str, name: str | None = None) -> ScalarUDF:
    """A scalar function from ``func(*pa.Array) -> pa.Array``."""
    if not callable(func):
        raise TypeError(f"a scalar function is made from a callable, not {func!r}")
    return ScalarUDF(name or func.__qualname__.lower(), func, input_types, return_type, volatility)


def udaf(accum: type[Accumulator], input_type: Any, return_type: pa.DataType, state_type: list[pa.DataType], volatility: str, name: str | None = None) -> AggregateUDF:
    """An aggregate function from an :class:`Accumulator` class."""
    if not issubclass(accum, Accumulator):
        raise TypeError(f"an aggregate is made from a subclass of Accumulator, not {accum!r}")
    return AggregateUDF(name or accum.__qualname__.lower(), accum, input_type, return_type, state_type, volatility)


def udwf(func: WindowEvaluator, input_types: pa.DataType | list[pa.DataType], return_type: pa.DataType, volatility: str, name: str | None = None) -> WindowUDF:
    """A window function from a :class:`WindowEvaluator` instance."""
    if not isinstance(func, WindowEvaluator):
        raise TypeError(f"a window function is made from a WindowEvaluator, not {func!r}")
    kinds = [input_types] if isinstance(input_types, pa.DataType) else input_types
    return WindowUDF(name or type(func).__qualname__.lower(), func, kinds, return_type, str(volatility))
