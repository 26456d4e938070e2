"""Logical plans as plain data: nodes with accessors, renderers, and a way back to Spark.

A plan comes from the builder (``table_scan(…).filter(…)``) or from Catalyst
(:func:`from_catalyst`, for parsed and optimized SQL); its expressions are
:mod:`larkspur.expr` trees, or SQL text where they come from Catalyst.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.expr import Alias, Expr
from larkspur.types import arrow_schema, spark_schema


@dataclass(eq=False, repr=False)
class SqlExpr(Expr):
    """An expression known by its SQL text."""

    sql: str

    def to_column(self):
        return F.expr(self.sql)

    def canonical_name(self) -> str:
        return self.sql


def _names(exprs: list[Expr]) -> str:
    return ", ".join(e.canonical_name() for e in exprs)


@dataclass(eq=False)
class Node:
    """A plan node; fields that are nodes are its inputs."""

    def inputs(self) -> list["Node"]:
        out = []
        for v in vars(self).values():
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, list) else []
        return out

    def to_variant(self) -> "Node":
        if isinstance(self, Union | Repartition | CreateMemoryTable | CreateView | DropTable):
            raise ValueError(f"Cannot convert this plan to a LogicalNode: {type(self).__name__}")
        return self

    def label(self) -> str:
        return type(self).__name__

    def display(self) -> str:
        return self.label()

    def display_indent(self, depth: int = 0) -> str:
        return "\n".join([f"{'  ' * depth}{self.label()}", *(i.display_indent(depth + 1) for i in self.inputs())])

    def display_indent_schema(self, depth: int = 0) -> str:
        names = ", ".join(self.field_names())
        return "\n".join([f"{'  ' * depth}{self.label()} [{names}]", *(i.display_indent_schema(depth + 1) for i in self.inputs())])

    def display_graphviz(self) -> str:
        lines, count = ["digraph {"], iter(range(1_000_000))

        def walk(node: Node) -> int:
            i = next(count)
            text = node.label().replace('"', '\\"')
            lines.append(f'  {i} [shape=box label="{text}"]')
            for child in node.inputs():
                j = walk(child)
                lines.append(f"  {i} -> {j} [arrowhead=none, arrowtail=normal, dir=back]")
            return i

        walk(self)
        return "\n".join([*lines, "}"])

    def field_names(self) -> list[str]:
        below = self.inputs()
        return below[0].field_names() if below else []

    def schema(self) -> list[str]:
        return self.field_names()

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        raise NotImplementedError(type(self).__name__)

    def __repr__(self) -> str:
        return self.display_indent()


@dataclass(eq=False, repr=False)
class TableScan(Node):
    name: str
    table_schema: pa.Schema | None = None
    projections: list[str] | None = None
    conditions: list[Expr] = field(default_factory=list)
    limit: int | None = None

    def table_name(self) -> str:
        return self.name.rpartition(".")[2]

    def fqn(self) -> tuple[str | None, str | None, str]:
        parts = [None, None, *self.name.split(".")][-3:]
        return parts[0], parts[1], parts[2]

    def projection(self) -> list[tuple[int, str]]:
        names = self.table_schema.names if self.table_schema is not None else self.projections or []
        return [(i, n) for i, n in enumerate(names) if self.projections is None or n in self.projections]

    def filters(self) -> list[Expr]:
        return self.conditions

    def fetch(self) -> int | None:
        return self.limit

    def field_names(self) -> list[str]:
        return [n for _, n in self.projection()]

    def label(self) -> str:
        shown = f" projection=[{', '.join(self.projections)}]" if self.projections is not None else ""
        return f"TableScan: {self.name}{shown}{f', full_filters=[{_names(self.conditions)}]' if self.conditions else ''}{f', fetch={self.limit}' if self.limit is not None else ''}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        df = spark.table(self.name)
        for c in self.conditions:
            df = df.where(c.to_column())
        df = df.select(*self.projections) if self.projections is not None else df
        return df.limit(self.limit) if self.limit is not None else df


@dataclass(eq=False, repr=False)
class Projection(Node):
    exprs: list[Expr]
    child: Node

    def projections(self) -> list[Expr]:
        return self.exprs

    def field_names(self) -> list[str]:
        return [e.schema_name() for e in self.exprs]

    def input(self) -> list[Node]:
        return [self.child]

    def label(self) -> str:
        return f"Projection: {_names(self.exprs)}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.child.to_df(spark).select(*(e.to_column() for e in self.exprs))


@dataclass(eq=False, repr=False)
class Filter(Node):
    condition: Expr
    child: Node

    def predicate(self) -> Expr:
        return self.condition

    def input(self) -> list[Node]:
        return [self.child]

    def label(self) -> str:
        return f"Filter: {self.condition.canonical_name()}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.child.to_df(spark).where(self.condition.to_column())


@dataclass(eq=False, repr=False)
class Aggregate(Node):
    groups: list[Expr]
    aggregates: list[Expr]
    child: Node

    def group_by_exprs(self) -> list[Expr]:
        return self.groups

    def aggregate_exprs(self) -> list[Expr]:
        return self.aggregates

    def agg_func_name(self, e: Expr) -> str:
        return (e.expr if hasattr(e, "alias_name") else e).aggregate_type()

    def aggregation_arguments(self, e: Expr) -> list[Expr]:
        return (e.expr if hasattr(e, "alias_name") else e).args

    def field_names(self) -> list[str]:
        return [e.schema_name() for e in [*self.groups, *self.aggregates]]

    def label(self) -> str:
        return f"Aggregate: groupBy=[[{_names(self.groups)}]], aggr=[[{_names(self.aggregates)}]]"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.child.to_df(spark).groupBy(*(g.to_column() for g in self.groups)).agg(*(a.to_column() for a in self.aggregates))


@dataclass(eq=False, repr=False)
class Join(Node):
    left_plan: Node
    right_plan: Node
    keys: list[tuple[Expr, Expr]]
    kind: str = "inner"
    residual: Expr | None = None
    constraint: str = "ON"
    nulls_equal: bool = False

    def left(self) -> Node:
        return self.left_plan

    def right(self) -> Node:
        return self.right_plan

    def on(self) -> list[tuple[Expr, Expr]]:
        return self.keys

    def filter(self) -> Expr | None:
        return self.residual

    def join_type(self) -> str:
        return self.kind

    def join_constraint(self) -> str:
        return self.constraint

    def null_equals_null(self) -> bool:
        return self.nulls_equal

    def field_names(self) -> list[str]:
        return self.left_plan.field_names() + ([] if "semi" in self.kind or "anti" in self.kind else self.right_plan.field_names())

    def label(self) -> str:
        on = ", ".join(f"{a.canonical_name()} = {b.canonical_name()}" for a, b in self.keys)
        return f"{self.kind.title()} Join: {on}{f' Filter: {self.residual.canonical_name()}' if self.residual is not None else ''}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        on = None
        for a, b in self.keys:
            one = a.to_column().eqNullSafe(b.to_column()) if self.nulls_equal else a.to_column() == b.to_column()
            on = one if on is None else on & one
        if self.residual is not None:
            on = self.residual.to_column() if on is None else on & self.residual.to_column()
        return self.left_plan.to_df(spark).join(self.right_plan.to_df(spark), on, self.kind)


@dataclass(eq=False, repr=False)
class Sort(Node):
    exprs: list[Expr]
    child: Node
    fetch: int | None = None

    def sort_exprs(self) -> list[Expr]:
        return self.exprs

    def get_fetch_val(self) -> int | None:
        return self.fetch

    def input(self) -> list[Node]:
        return [self.child]

    def label(self) -> str:
        return f"Sort: {_names(self.exprs)}{f', fetch={self.fetch}' if self.fetch is not None else ''}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        df = self.child.to_df(spark).orderBy(*(e.to_column() for e in self.exprs))
        return df.limit(self.fetch) if self.fetch is not None else df


@dataclass(eq=False, repr=False)
class Limit(Node):
    skip_rows: int
    fetch_rows: int | None
    child: Node

    def __post_init__(self):
        if self.skip_rows < 0 or (self.fetch_rows or 0) < 0:
            raise ValueError("skip and fetch can't be negative")

    def skip(self) -> int:
        return self.skip_rows

    def fetch(self) -> int | None:
        return self.fetch_rows

    def label(self) -> str:
        return f"Limit: skip={self.skip_rows}, fetch={self.fetch_rows}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        df = self.child.to_df(spark)
        df = df.offset(self.skip_rows) if self.skip_rows else df
        return df.limit(self.fetch_rows) if self.fetch_rows is not None else df


@dataclass(eq=False, repr=False)
class Window(Node):
    exprs: list[Expr]
    child: Node

    def get_window_expr(self) -> list[Expr]:
        return self.exprs

    def get_sort_exprs(self, e: Any) -> list[Expr]:
        return _plain(e).order_by

    def get_partition_exprs(self, e: Any) -> list[Expr]:
        return _plain(e).partition_by

    def get_args(self, e: Any) -> list[Expr]:
        return _plain(e).fn.args

    def window_func_name(self, e: Any) -> str:
        return _plain(e).fn.fn

    def get_frame(self, e: Any) -> Any:
        return _plain(e).frame

    def field_names(self) -> list[str]:
        return self.child.field_names() + [e.schema_name() for e in self.exprs]

    def label(self) -> str:
        return f"WindowAggr: windowExpr=[[{_names(self.exprs)}]]"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.child.to_df(spark).select("*", *(e.to_column() for e in self.exprs))


def _plain(e: Any) -> Any:
    return e.expr if hasattr(e, "alias_name") else e


@dataclass(eq=False, repr=False)
class Distinct(Node):
    child: Node
    on: list[Expr] | None = None

    def input(self) -> list[Node]:
        return [self.child]

    def label(self) -> str:
        return f"DistinctOn: on_expr=[[{_names(self.on)}]]" if self.on else "Distinct:"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        df = self.child.to_df(spark)
        return df.dropDuplicates([e.canonical_name() for e in self.on]) if self.on else df.distinct()


@dataclass(eq=False, repr=False)
class Subquery(Node):
    plan: Node

    def input(self) -> list[Node]:
        return [self.plan]

    def inputs(self) -> list[Node]:
        return []

    def label(self) -> str:
        return "Subquery:"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.plan.to_df(spark)


@dataclass(eq=False, repr=False)
class SubqueryAlias(Node):
    name: str
    child: Node

    def alias(self) -> str:
        return self.name

    def input(self) -> list[Node]:
        return [self.child]

    def label(self) -> str:
        return f"SubqueryAlias: {self.name}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return self.child.to_df(spark).alias(self.name)


@dataclass(eq=False, repr=False)
class EmptyRelation(Node):
    one_row: bool = False
    arrow: pa.Schema | None = None

    def produce_one_row(self) -> bool:
        return self.one_row

    def arrow_schema(self) -> pa.Schema:
        return self.arrow or pa.schema([])

    def field_names(self) -> list[str]:
        return self.arrow_schema().names

    def label(self) -> str:
        return "EmptyRelation"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        return spark.range(1).select() if self.one_row else spark.createDataFrame([], spark_schema(self.arrow_schema()))


@dataclass(eq=False, repr=False)
class Explain(Node):
    plan: Node
    is_verbose: bool = False

    def verbose(self) -> bool:
        return self.is_verbose

    def explain_string(self) -> list[str]:
        return [self.plan.display_indent()]

    def field_names(self) -> list[str]:
        return ["plan_type", "plan"]

    def label(self) -> str:
        return "Explain"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        text = self.plan.to_df(spark)._jdf.queryExecution().optimizedPlan().toString()
        return spark.createDataFrame([("logical_plan", text)], "plan_type string, plan string")


@dataclass(eq=False, repr=False)
class Analyze(Explain):
    def label(self) -> str:
        return "Analyze"


@dataclass(eq=False, repr=False)
class Extension(Node):
    node_name: str

    def name(self) -> str:
        return self.node_name

    def label(self) -> str:
        return f"Extension: {self.node_name}"


@dataclass(eq=False, repr=False)
class Union(Node):
    parts: list[Node]

    def input(self) -> list[Node]:
        return self.parts

    def label(self) -> str:
        return "Union"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        out = self.parts[0].to_df(spark)
        for p in self.parts[1:]:
            out = out.union(p.to_df(spark))
        return out


@dataclass(eq=False, repr=False)
class Partitioning:
    scheme: str
    count: int | None = None
    columns: list[Expr] = field(default_factory=list)


@dataclass(eq=False, repr=False)
class Repartition(Node):
    how: Partitioning
    child: Node

    def partitioning_scheme(self) -> Partitioning:
        return self.how

    def distribute_list(self) -> list[Expr]:
        if self.how.scheme != "DistributeBy":
            raise TypeError("unexpected repartition strategy")
        return self.how.columns

    def distribute_columns(self) -> str:
        return "".join(c.canonical_name() for c in self.distribute_list())

    def label(self) -> str:
        return f"Repartition: {self.how.scheme}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        df, columns = self.child.to_df(spark), [c.to_column() for c in self.how.columns]
        return df.repartition(self.how.count, *columns) if self.how.count else df.repartition(*columns)


@dataclass(eq=False, repr=False)
class CreateMemoryTable(Node):
    table: str
    child: Node
    replace: bool = False
    not_exists: bool = False

    def name(self) -> str:
        return self.table

    def input(self) -> list[Node]:
        return [self.child]

    def or_replace(self) -> bool:
        return self.replace

    def if_not_exists(self) -> bool:
        return self.not_exists

    def label(self) -> str:
        return f"CreateMemoryTable: {self.table}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        if not (self.not_exists and spark.catalog.tableExists(self.table)):
            df = self.child.to_df(spark)
            df.createOrReplaceTempView(self.table) if self.replace else df.createTempView(self.table)
        return spark.createDataFrame([], T.StructType([]))


@dataclass(eq=False, repr=False)
class CreateView(CreateMemoryTable):
    sql: str | None = None

    def definition(self) -> str | None:
        return self.sql

    def label(self) -> str:
        return f"CreateView: {self.table}"


@dataclass(eq=False, repr=False)
class DropTable(Node):
    table: str
    exists: bool = False

    def name(self) -> str:
        return self.table

    def if_exists(self) -> bool:
        return self.exists

    def label(self) -> str:
        return f"DropTable: {self.table} if not exist:={self.exists}"

    def to_df(self, spark: SparkSession) -> SparkDataFrame:
        if not spark.catalog.dropTempView(self.table) and not self.exists:
            raise ValueError(f"no table {self.table!r}")
        return spark.createDataFrame([], T.StructType([]))


@dataclass(eq=False, repr=False)
class CatalystNode(Node):
    """A node of another kind, shown by Catalyst's own text."""

    text: str
    below: list[Node]

    def label(self) -> str:
        return self.text


def _seq(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _sql(exprs: Any) -> list[Expr]:
    return [Alias(SqlExpr(e.child().sql()), e.name()) if e.nodeName() == "Alias" else SqlExpr(e.sql()) for e in _seq(exprs)]


def from_catalyst(plan: Any) -> Node:
    """The tree of a Catalyst logical plan."""
    below = [from_catalyst(c) for c in _seq(plan.children())]
    kind = plan.nodeName()
    if kind == "Project":
        return Projection(_sql(plan.projectList()), below[0])
    if kind == "Filter":
        return Filter(SqlExpr(plan.condition().sql()), below[0])
    if kind == "Aggregate":
        groups = _sql(plan.groupingExpressions())
        return Aggregate(groups, [e for e in _sql(plan.aggregateExpressions()) if e.canonical_name() not in {g.canonical_name() for g in groups}], below[0])
    if kind == "Join":
        condition = plan.condition()
        return Join(below[0], below[1], [], plan.joinType().sql().lower(), SqlExpr(condition.get().sql()) if condition.isDefined() else None)
    if kind == "Sort":
        return Sort(_sql(plan.order()), below[0])
    if kind in ("GlobalLimit", "LocalLimit"):
        inner = below[0].child if isinstance(below[0], Limit) and kind == "GlobalLimit" else below[0]
        text = plan.limitExpr().sql()
        return Limit(0, int(text) if text.isdigit() else None, inner)
    if kind == "Offset":
        text = plan.offsetExpr().sql()
        return Limit(int(text) if text.isdigit() else 0, None, below[0])
    if kind == "Window":
        return Window(_sql(plan.windowExpressions()), below[0])
    if kind in ("Distinct", "Deduplicate"):
        return Distinct(below[0])
    if kind == "SubqueryAlias":
        if plan.child().nodeName() == "View":  # a registered table
            schema = arrow_schema(T.StructType.fromJson(json.loads(plan.child().schema().json())))
            return SubqueryAlias(plan.alias(), TableScan(plan.child().desc().identifier().table(), schema))
        return SubqueryAlias(plan.alias(), below[0])
    if kind == "Union":
        return Union(below)
    if kind == "OneRowRelation":
        return EmptyRelation(True)
    if kind in ("Repartition", "RepartitionByExpression"):
        return Repartition(Partitioning("RoundRobin", plan.numPartitions()), below[0])
    if not below:
        names = [a.name() for a in _seq(plan.output())]
        if kind == "LocalRelation" and plan.data().isEmpty():
            return EmptyRelation(False, pa.schema([(n, pa.null()) for n in names]))
        return TableScan(kind, pa.schema([(n, pa.null()) for n in names]))
    return CatalystNode(plan.simpleString(200), below)
