"""An immutable expression tree over Spark columns, with introspection.

``Expr.to_column()`` gives the Spark column; the classes and accessors tell
what an expression is made of, which Spark's own columns don't.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from larkspur.functions.library import call, similar_pattern
from larkspur.types import DataTypeMap, RexType, to_spark


def _expr(value: Any) -> "Expr":
    return value if isinstance(value, Expr) else Literal(value)


class Expr:
    """Base of all expressions; built with operators, ``Expr.column`` and ``Expr.literal``."""

    # building
    @staticmethod
    def column(name: str) -> "Column":
        return Column(name)

    @staticmethod
    def literal(value: Any) -> "Literal":
        return Literal(value.as_py(), value.type) if isinstance(value, pa.Scalar) else Literal(value)

    def alias(self, name: str) -> "Alias":
        return Alias(self, name)

    def _binary(self, op: str, other: Any) -> "BinaryExpr":
        return BinaryExpr(self, op, _expr(other))

    def __lt__(self, other): return self._binary("<", other)  # noqa: E704
    def __le__(self, other): return self._binary("<=", other)  # noqa: E704
    def __eq__(self, other): return self._binary("=", other)  # noqa: E704
    def __ne__(self, other): return self._binary("!=", other)  # noqa: E704
    def __ge__(self, other): return self._binary(">=", other)  # noqa: E704
    def __gt__(self, other): return self._binary(">", other)  # noqa: E704
    def __add__(self, other): return self._binary("+", other)  # noqa: E704
    def __sub__(self, other): return self._binary("-", other)  # noqa: E704
    def __mul__(self, other): return self._binary("*", other)  # noqa: E704
    def __truediv__(self, other): return self._binary("/", other)  # noqa: E704
    def __mod__(self, other): return self._binary("%", other)  # noqa: E704
    def __and__(self, other): return self._binary("AND", other)  # noqa: E704
    def __or__(self, other): return self._binary("OR", other)  # noqa: E704
    def __invert__(self): return Not(self)  # noqa: E704
    def __getitem__(self, key): return GetField(self, key)  # noqa: E704
    def __neg__(self): return Negative(self)  # noqa: E704
    def __hash__(self): return id(self)  # noqa: E704

    def sort(self, ascending: bool = True, nulls_first: bool = True) -> "SortExpr":
        return SortExpr(self, ascending, nulls_first)

    def is_null(self) -> "Unary":
        return IsNull(self)

    def cast(self, to: pa.DataType) -> "Cast":
        return Cast(self, to)

    # meaning
    def to_column(self) -> SparkColumn:
        raise NotImplementedError(self.variant_name())

    # introspection
    def children(self) -> list["Expr"]:
        return []

    def to_variant(self) -> "Expr":
        if type(self) in _NO_VARIANT:
            raise RuntimeError(f"Cannot convert this Expr to a variant: {self.variant_name()}")
        return self

    def variant_name(self) -> str:
        return type(self).__name__

    def schema_name(self) -> str:
        return self.canonical_name()

    def canonical_name(self) -> str:
        return type(self).__name__

    def column_name(self, plan: Any = None) -> str:
        return self.schema_name()

    def rex_type(self) -> RexType:
        if isinstance(self, Alias):
            return RexType.Alias
        if isinstance(self, Literal):
            return RexType.Literal
        if isinstance(self, Column | ScalarVariable):
            return RexType.Reference
        if isinstance(self, ScalarSubquery):
            return RexType.ScalarSubquery
        return RexType.Other if isinstance(self, Wildcard | Placeholder | GroupingSet) else RexType.Call

    def types(self) -> DataTypeMap:
        if isinstance(self, BinaryExpr):
            if self.op in _OP_TYPES:
                return DataTypeMap.arrow(_OP_TYPES[self.op])
            raise TypeError(f"Unsupported expr: {self.op}")
        if isinstance(self, Cast):
            return DataTypeMap.arrow(self.to)
        if isinstance(self, Literal):
            return DataTypeMap.arrow(self.arrow_type())
        raise TypeError(f"Non Expr::Literal encountered in types: {self.canonical_name()}")

    def python_value(self) -> Any:
        if not isinstance(self, Literal):
            raise TypeError(f"not a literal: {self.canonical_name()}")
        if self.value is None:
            raise NotImplementedError("a null has no Python value here")
        return self.value

    def rex_call_operands(self) -> list["Expr"]:
        if isinstance(self, Column | ScalarVariable | Literal):
            return [self]
        if isinstance(self, GroupingSet | Wildcard | ScalarSubquery | Placeholder | Exists):
            raise RuntimeError(f"Unimplemented Expr type: {self.canonical_name()}")
        return self.children()

    def rex_call_operator(self) -> str:
        name = self._operator()
        if name is None:
            raise TypeError(f"no operator: {self.canonical_name()}")
        return name

    def _operator(self) -> str | None:
        return None

    def __repr__(self) -> str:
        return f"Expr({self.canonical_name()})"


@dataclass(eq=False, repr=False)
class Column(Expr):
    """A column, with an optional relation before the dot."""

    text: str

    def to_column(self) -> SparkColumn:
        return F.col(".".join(f"`{p}`" for p in self.text.split("."))) if "`" not in self.text else F.col(self.text)

    def name(self) -> str:
        return self.text.rpartition(".")[2]

    def relation(self) -> str | None:
        return self.text.rpartition(".")[0] or None

    def qualified_name(self) -> str:
        return self.text

    def canonical_name(self) -> str:
        return self.text


@dataclass(eq=False, repr=False)
class Literal(Expr):
    value: Any
    kind: pa.DataType | None = None

    def arrow_type(self) -> pa.DataType:
        return self.kind or pa.scalar(self.value).type

    def data_type(self) -> str:
        return DataTypeMap.arrow(self.arrow_type()).friendly_arrow_type_name()

    def to_column(self) -> SparkColumn:
        c = F.lit(self.value)
        return c.cast(to_spark(self.kind)) if self.kind is not None else c

    def _typed(self, *kinds: type) -> Any:
        if self.value is not None and (not isinstance(self.value, kinds) or isinstance(self.value, bool) and bool not in kinds):
            raise TypeError(f"unexpected value {self.value!r}")
        return self.value

    def value_bool(self): return self._typed(bool)  # noqa: E704
    def value_i8(self): return self._typed(int)  # noqa: E704
    value_i16 = value_i32 = value_i64 = value_u8 = value_u16 = value_u32 = value_u64 = value_i8
    def value_f32(self): return self._typed(float)  # noqa: E704
    value_f64 = value_f32
    def value_string(self): return self._typed(str)  # noqa: E704
    def value_binary(self): return self._typed(bytes)  # noqa: E704
    def value_decimal128(self): return self._typed(decimal.Decimal)  # noqa: E704
    def value_date32(self): return self._typed(datetime.date)  # noqa: E704
    value_date64 = value_date32
    def value_time64(self): return self._typed(datetime.time)  # noqa: E704
    def value_timestamp(self): return self._typed(datetime.datetime)  # noqa: E704
    def value_interval_day_time(self): return self._typed(datetime.timedelta)  # noqa: E704

    def canonical_name(self) -> str:
        return f'Utf8("{self.value}")' if isinstance(self.value, str) else "NULL" if self.value is None else f"{self.data_type()}({self.value})"


@dataclass(eq=False, repr=False)
class Alias(Expr):
    expr: Expr
    name: str

    def alias_name(self) -> str:
        return self.name

    def children(self) -> list[Expr]:
        return [self.expr]

    def to_column(self) -> SparkColumn:
        return self.expr.to_column().alias(self.name)

    def schema_name(self) -> str:
        return self.name

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()} AS {self.name}"


_BINARY = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "AND": lambda a, b: a & b, "OR": lambda a, b: a | b,
    "IS DISTINCT FROM": lambda a, b: ~a.eqNullSafe(b), "IS NOT DISTINCT FROM": lambda a, b: a.eqNullSafe(b), "~": lambda a, b: F.rlike(a, b), "~*": lambda a, b: F.rlike(a, F.concat(F.lit("(?i)"), b)),
    "!~": lambda a, b: ~F.rlike(a, b), "!~*": lambda a, b: ~F.rlike(a, F.concat(F.lit("(?i)"), b)), "~~": lambda a, b: F.like(a, b), "~~*": lambda a, b: F.ilike(a, b), "!~~": lambda a, b: ~F.like(a, b),
    "!~~*": lambda a, b: ~F.ilike(a, b), "||": lambda a, b: F.concat(a.cast("string"), b.cast("string")), "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")), "BIT_XOR": lambda a, b: a.bitwiseXOR(b), "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b),
    "@>": lambda a, b: F.size(F.array_except(b, a)) == 0, "<@": lambda a, b: F.size(F.array_except(a, b)) == 0,
}
_OP_TYPES = {
    **dict.fromkeys(["<", "<=", "=", "!=", ">", ">=", "AND", "OR", "IS DISTINCT FROM", "IS NOT DISTINCT FROM", "~", "~*", "!~", "!~*", "~~", "~~*", "!~~", "!~~*"], pa.bool_()),
    **dict.fromkeys(["+", "-", "*", "%"], pa.int64()), "/": pa.float64(), "||": pa.string(), **dict.fromkeys(["<<", ">>", "BIT_XOR", "&", "|"], pa.binary()),
}


@dataclass(eq=False, repr=False)
class BinaryExpr(Expr):
    lhs: Expr
    op: str
    rhs: Expr

    def left(self) -> Expr:
        return self.lhs

    def right(self) -> Expr:
        return self.rhs

    def children(self) -> list[Expr]:
        return [self.lhs, self.rhs]

    def to_column(self) -> SparkColumn:
        return _BINARY[self.op](self.lhs.to_column(), self.rhs.to_column())

    def _operator(self) -> str:
        return self.op

    def canonical_name(self) -> str:
        return f"{self.lhs.canonical_name()} {self.op} {self.rhs.canonical_name()}"


@dataclass(eq=False, repr=False)
class Unary(Expr):
    expr: Expr
    _name = ""
    _make = staticmethod(lambda c: c)

    def children(self) -> list[Expr]:
        return [self.expr]

    def to_column(self) -> SparkColumn:
        return self._make(self.expr.to_column())

    def _operator(self) -> str:
        return self._name

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()} {self._name.upper()}" if self._name.startswith("is") else f"{self._name.upper()} {self.expr.canonical_name()}"


def _unary(name: str, operator: str, make) -> type[Unary]:
    return type(name, (Unary,), {"_name": operator, "_make": staticmethod(make), "__doc__": f"The operator {operator}."})


Not = _unary("Not", "not", lambda c: ~c)
IsNull = _unary("IsNull", "is null", lambda c: c.isNull())
IsNotNull = _unary("IsNotNull", "is not null", lambda c: c.isNotNull())
IsTrue = _unary("IsTrue", "is true", lambda c: c.eqNullSafe(F.lit(True)))
IsFalse = _unary("IsFalse", "is false", lambda c: c.eqNullSafe(F.lit(False)))
IsUnknown = _unary("IsUnknown", "is unknown", lambda c: c.isNull())
IsNotTrue = _unary("IsNotTrue", "is not true", lambda c: ~c.eqNullSafe(F.lit(True)))
IsNotFalse = _unary("IsNotFalse", "is not false", lambda c: ~c.eqNullSafe(F.lit(False)))
IsNotUnknown = _unary("IsNotUnknown", "is not unknown", lambda c: c.isNotNull())
Negative = _unary("Negative", "negative", lambda c: -c)


@dataclass(eq=False, repr=False)
class Like(Expr):
    expr: Expr
    what: Expr
    negated: bool = False
    escape: str | None = None
    _word = "like"

    def pattern(self) -> Expr:
        return self.what

    def escape_char(self) -> str | None:
        return self.escape

    def children(self) -> list[Expr]:
        return [self.expr, self.what]

    def to_column(self) -> SparkColumn:
        fn = F.ilike if self._word == "ilike" else F.like
        c = fn(self.expr.to_column(), self.what.to_column(), F.lit(self.escape)) if self.escape else fn(self.expr.to_column(), self.what.to_column())
        return ~c if self.negated else c

    def _operator(self) -> str:
        return f"not {self._word}" if self.negated else self._word

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()} {self._operator().upper()} {self.what.canonical_name()}"


class ILike(Like):
    _word = "ilike"


class SimilarTo(Like):
    _word = "similar to"

    def to_column(self) -> SparkColumn:
        c = self.expr.to_column().rlike(similar_pattern(self.what.python_value()))
        return ~c if self.negated else c


@dataclass(eq=False, repr=False)
class Between(Expr):
    expr: Expr
    low: Expr
    high: Expr
    negated: bool = False

    def children(self) -> list[Expr]:
        return [self.expr, self.low, self.high]

    def to_column(self) -> SparkColumn:
        c = self.expr.to_column().between(self.low.to_column(), self.high.to_column())
        return ~c if self.negated else c

    def _operator(self) -> str:
        return "between"

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()} {'NOT ' * self.negated}BETWEEN {self.low.canonical_name()} AND {self.high.canonical_name()}"


@dataclass(eq=False, repr=False)
class InList(Expr):
    expr: Expr
    items: list[Expr]
    negated: bool = False

    def list(self) -> list[Expr]:
        return self.items

    def children(self):
        return [self.expr, *self.items]

    def to_column(self) -> SparkColumn:
        c = self.expr.to_column().isin(*(i.to_column() for i in self.items))
        return ~c if self.negated else c

    def _operator(self) -> str:
        return "in list"

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()} {'NOT ' * self.negated}IN ([{', '.join(i.canonical_name() for i in self.items)}])"


@dataclass(eq=False, repr=False)
class Case(Expr):
    base: Expr | None
    arms: list[tuple[Expr, Expr]]
    other: Expr | None = None

    def expr(self) -> Expr | None:
        return self.base

    def when_then_expr(self) -> list[tuple[Expr, Expr]]:
        return self.arms

    def else_expr(self) -> Expr | None:
        return self.other

    def children(self) -> list[Expr]:
        out = []
        for when, then in self.arms:
            out += [self.base == when if self.base is not None else when, then]
        return [*out, self.other] if self.other is not None else out

    def to_column(self) -> SparkColumn:
        c = F
        for when, then in self.arms:
            test = self.base == when if self.base is not None else when
            c = c.when(test.to_column(), then.to_column())
        return c.otherwise(self.other.to_column()) if self.other is not None else c

    def _operator(self) -> str:
        return "case"

    def canonical_name(self) -> str:
        arms = " ".join(f"WHEN {w.canonical_name()} THEN {t.canonical_name()}" for w, t in self.arms)
        return f"CASE {self.base.canonical_name() + ' ' if self.base is not None else ''}{arms}{' ELSE ' + self.other.canonical_name() if self.other is not None else ''} END"


class CaseBuilder:
    """case(x).when(…, …).otherwise(…), or .end() without an else."""

    def __init__(self, base: Expr | None = None):
        self.base, self.arms = base, []

    def when(self, test: Expr, then: Any) -> "CaseBuilder":
        self.arms.append((_expr(test), _expr(then)))
        return self

    def otherwise(self, value: Any) -> Case:
        return Case(self.base, self.arms, _expr(value))

    def end(self) -> Case:
        return Case(self.base, self.arms)


@dataclass(eq=False, repr=False)
class Cast(Expr):
    expr: Expr
    to: pa.DataType

    def data_type(self) -> pa.DataType:
        return self.to

    def children(self) -> list[Expr]:
        return [self.expr]

    def to_column(self) -> SparkColumn:
        return self.expr.to_column().cast(to_spark(self.to))

    def _operator(self) -> str:
        return "cast"

    def canonical_name(self) -> str:
        return f"CAST({self.expr.canonical_name()} AS {DataTypeMap.arrow(self.to).friendly_arrow_type_name()})"


class TryCast(Cast):
    def to_column(self) -> SparkColumn:
        return self.expr.to_column().try_cast(to_spark(self.to))

    def _operator(self) -> None:
        return None


@dataclass(eq=False, repr=False)
class GetField(Expr):
    expr: Expr
    key: Any

    def children(self) -> list[Expr]:
        return [self.expr]

    def to_column(self) -> SparkColumn:
        return self.expr.to_column()[self.key]

    def canonical_name(self) -> str:
        return f"{self.expr.canonical_name()}[{self.key}]"


@dataclass(eq=False, repr=False)
class SortExpr(Expr):
    over: Expr
    asc: bool = True
    first: bool = True

    def expr(self) -> Expr:
        return self.over

    def ascending(self) -> bool:
        return self.asc

    def nulls_first(self) -> bool:
        return self.first

    def children(self) -> list[Expr]:
        return [self.over]

    def to_column(self) -> SparkColumn:
        return getattr(self.over.to_column(), f"{'asc' if self.asc else 'desc'}_nulls_{'first' if self.first else 'last'}")()

    def canonical_name(self) -> str:
        return f"{self.over.canonical_name()} {'ASC' if self.asc else 'DESC'} NULLS {'FIRST' if self.first else 'LAST'}"


@dataclass(eq=False, repr=False)
class ScalarFunction(Expr):
    fn: str
    args: list[Any]

    def children(self) -> list[Expr]:
        return [a for a in self.args if isinstance(a, Expr)]

    def to_column(self) -> SparkColumn:
        return call(self.fn, *(a.to_column() if isinstance(a, Expr) else a for a in self.args))

    def _operator(self) -> str:
        return self.fn

    def canonical_name(self) -> str:
        return f"{self.fn}({', '.join(a.canonical_name() if isinstance(a, Expr) else str(a) for a in self.args)})"


@dataclass(eq=False, repr=False)
class AggregateFunction(ScalarFunction):
    distinct: bool = False

    def aggregate_type(self) -> str:
        return self.fn

    def is_distinct(self) -> bool:
        return self.distinct

    def to_column(self) -> SparkColumn:
        args = [a.to_column() if isinstance(a, Expr) else a for a in self.args]
        if self.distinct:
            if self.fn in ("count", "sum"):
                return (F.count_distinct if self.fn == "count" else F.sum_distinct)(*args)
            return call(self.fn, F.array_distinct(F.collect_list(args[0]))) if self.fn == "array_agg" else getattr(F, self.fn)(*args)
        return call(self.fn, *args)

    def _operator(self) -> None:
        return None


@dataclass(frozen=True)
class WindowFrameBound:
    """An end of a frame: ``offset`` rows, or unbounded (None), before or after the current row."""

    offset: Any
    side: str

    def is_current_row(self) -> bool:
        return self.offset == 0

    def is_preceding(self) -> bool:
        return self.side == "preceding"

    def is_following(self) -> bool:
        return self.side == "following"

    def is_unbounded(self) -> bool:
        return self.offset is None

    def get_offset(self) -> Any:
        return int(self.offset) if isinstance(self.offset, str) and self.offset.lstrip("-").isdigit() else self.offset


@dataclass(frozen=True)
class WindowFrame:
    """A frame from ``start`` preceding to ``end`` following; None is unbounded."""

    units: str
    start: Any = None
    end: Any = None

    def __post_init__(self):
        if self.units.lower() not in ("rows", "range", "groups"):
            raise NotImplementedError(self.units)
        if self.units.lower() == "groups" and (self.start is None or self.end is None):
            raise NotImplementedError("groups needs both ends")

    def get_frame_units(self) -> str:
        return self.units.upper()

    def get_lower_bound(self) -> WindowFrameBound:
        return WindowFrameBound(self.start, "preceding")

    def get_upper_bound(self) -> WindowFrameBound:
        return WindowFrameBound(self.end, "following")

    def apply(self, spec):
        lo = SparkWindow.unboundedPreceding if self.start is None else -self.start
        hi = SparkWindow.unboundedFollowing if self.end is None else self.end
        if self.units.lower() == "rows":
            return spec.rowsBetween(lo, hi)
        return spec.rangeBetween(lo, hi)


@dataclass(eq=False, repr=False)
class WindowExpr(Expr):
    """A function over a window. A GROUPS frame needs :func:`larkspur.operators.windows.groups_frame`."""

    fn: ScalarFunction
    partition_by: list[Expr] = field(default_factory=list)
    order_by: list[Expr] = field(default_factory=list)
    frame: WindowFrame | None = None

    def children(self) -> list[Expr]:
        return self.fn.children()

    def to_column(self) -> SparkColumn:
        spec = SparkWindow.partitionBy(*(p.to_column() for p in self.partition_by))
        if self.order_by:
            spec = spec.orderBy(*(o.to_column() for o in self.order_by))
        if self.frame:
            spec = self.frame.apply(spec)
        return self.fn.to_column().over(spec)

    def canonical_name(self) -> str:
        by = f"PARTITION BY [{', '.join(p.canonical_name() for p in self.partition_by)}] " if self.partition_by else ""
        order = f"ORDER BY [{', '.join(o.canonical_name() for o in self.order_by)}]" if self.order_by else ""
        return f"{self.fn.canonical_name()} {by}{order}".strip()


@dataclass(eq=False, repr=False)
class Placeholder(Expr):
    key: str
    kind: pa.DataType | None = None

    def id(self) -> str:
        return self.key

    def data_type(self) -> pa.DataType | None:
        return self.kind

    def to_column(self) -> SparkColumn:
        raise ValueError(f"{self.key} has no value; pass it to sql(…, args=…)")

    def canonical_name(self) -> str:
        return self.key


@dataclass(eq=False, repr=False)
class ScalarVariable(Expr):
    kind: pa.DataType
    names: list[str]

    def data_type(self) -> pa.DataType:
        return self.kind

    def variables(self) -> list[str]:
        return self.names

    def to_column(self) -> SparkColumn:
        return F.expr(".".join(n.lstrip("@") for n in self.names)).cast(to_spark(self.kind))

    def canonical_name(self) -> str:
        return ".".join(self.names)


@dataclass(eq=False, repr=False)
class Wildcard(Expr):
    relation: str | None = None

    def to_column(self) -> SparkColumn:
        return F.col(f"{self.relation}.*" if self.relation else "*")

    def canonical_name(self) -> str:
        return f"{self.relation}.*" if self.relation else "*"


@dataclass(eq=False, repr=False)
class GroupingSet(Expr):
    sets: list[list[Expr]]

    def canonical_name(self) -> str:
        return f"GROUPING SETS ({', '.join('(' + ', '.join(e.canonical_name() for e in s) + ')' for s in self.sets)})"


@dataclass(eq=False, repr=False)
class ScalarSubquery(Expr):
    plan: Any

    def subquery(self) -> Any:
        return self.plan

    def to_column(self) -> SparkColumn:
        return self.plan.to_df().scalar()

    def canonical_name(self) -> str:
        return "(<subquery>)"


@dataclass(eq=False, repr=False)
class Exists(Expr):
    plan: Any
    is_negated: bool = False

    def subquery(self) -> Any:
        return self.plan

    def negated(self) -> bool:
        return self.is_negated

    def to_column(self) -> SparkColumn:
        c = self.plan.to_df().exists()
        return ~c if self.is_negated else c

    def canonical_name(self) -> str:
        return "NOT EXISTS" if self.is_negated else "EXISTS"


@dataclass(eq=False, repr=False)
class InSubquery(Expr):
    over: Expr
    plan: Any
    is_negated: bool = False

    def expr(self) -> Expr:
        return self.over

    def subquery(self) -> Any:
        return self.plan

    def negated(self) -> bool:
        return self.is_negated

    def children(self) -> list[Expr]:
        return [self.over]

    def to_column(self) -> SparkColumn:
        c = self.over.to_column().isin(self.plan.to_df())
        return ~c if self.is_negated else c

    def canonical_name(self) -> str:
        return f"{self.over.canonical_name()} {'NOT ' * self.is_negated}IN (<subquery>)"


_NO_VARIANT: tuple[type, ...] = (GetField, WindowExpr, Wildcard, SortExpr)
col = Expr.column
lit = Expr.literal


def case(base: Expr | None = None) -> CaseBuilder:
    return CaseBuilder(base)


def function(name: str, *args: Any) -> ScalarFunction:
    return ScalarFunction(name, list(args))


def aggregate(name: str, *args: Any, distinct: bool = False) -> AggregateFunction:
    return AggregateFunction(name, list(args), distinct)


def __getattr__(name: str):
    """Plan nodes can be had from here as well."""
    from larkspur.plans import nodes

    if hasattr(nodes, name) and not name.startswith("_"):
        return getattr(nodes, name)
    raise AttributeError(f"module 'larkspur.expr' has no attribute {name!r}")
