"""The package's exports, sessions, catalog, expressions and plans."""

from __future__ import annotations

import pyarrow as pa
import pytest

import larkspur
from larkspur import SessionConfig, SessionContext, SessionState, col, lit
from larkspur.common import DataTypeMap, DFSchema, PythonType, SqlSchema, SqlTable, SqlType
from larkspur.expr import Between, BinaryExpr, Case, IsNull, Like, Literal, WindowFrame, case
from larkspur.types import DataType, RexType


def test_has_all():
    assert all(hasattr(larkspur, name) for name in larkspur.__all__)
    with pytest.raises(AttributeError):
        larkspur.absent  # noqa: B018


def test_config_and_state(spark):
    config = SessionConfig({"execution.batch_size": "1000"}).with_target_partitions(3).with_repartition_joins(False).set("custom.key", "v")
    ctx = SessionContext(config=config)
    assert ctx.spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert ctx.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert "custom.key=v" in repr(ctx) and ctx.session_id() in repr(ctx)
    state = SessionState()
    assert state.config.information_schema and not config.information_schema

    class Rule(larkspur.OptimizationRule):
        def try_optimize(self, plan):
            return plan.where("id > 1")

    ruled = SessionContext(session_state=state.add_optimizer_rule(Rule()))
    assert ruled.sql("SELECT * FROM range(4)").count() == 2 and not state.rules


def test_catalog(ctx):
    ctx.register_record_batches("t", [[pa.record_batch({"a": [1, 2]})]])
    assert ctx.tables() == {"t"} and ctx.table_exist("t")
    table = ctx.catalog().database().table("t")
    assert table.kind == "temporary" and table.schema.names == ["a"]
    ctx.register_table("u", table)
    ctx.register_dataframe("v", ctx.table("t"))
    assert ctx.sql("SELECT count(*) AS n FROM u JOIN v ON u.a = v.a").to_pylist() == [{"n": 2}]
    ctx.deregister_table("u")
    assert ctx.tables() == {"t", "v"} and ctx.empty_table().schema().names == []
    for bad in (lambda: ctx.catalog("x"), lambda: ctx.catalog().database("x"), lambda: ctx.catalog().database().table("x")):
        with pytest.raises(KeyError):
            bad()


def test_information_schema_and_statements(ctx):
    ctx.register_record_batches("t", [[pa.record_batch({"a": [1, 2, 3]})]])
    assert ctx.sql("SELECT table_name FROM information_schema.tables").to_pydict() == {"table_name": ["t"]}
    ctx.sql("PREPARE p AS SELECT a FROM t WHERE a > $1")
    assert ctx.sql("EXECUTE p(1)").count() == 2
    with pytest.raises(ValueError):
        ctx.sql("EXECUTE nothing(1)")
    assert ctx.sql("SELECT a FROM t WHERE a = $x", {"x": 2}).to_pylist() == [{"a": 2}]


def test_type_labels():
    assert DataTypeMap.arrow(pa.uint32()).sql_type is SqlType.INTEGER and DataTypeMap.arrow(pa.string()).python_type is PythonType.Str
    assert DataTypeMap.sql(SqlType.CHAR).arrow_type.data_type == pa.uint8() and DataTypeMap.sql(SqlType.INTEGER).arrow_type.data_type == pa.int8()
    assert DataTypeMap.from_parquet_type_str("BYTE_ARRAY").friendly_arrow_type_name() == "Utf8"
    assert DataType.from_arrow_str("datetime64[ns, UTC]").data_type == pa.date64() and DataType(pa.string()).to_arrow_str() == "object"
    for bad in (lambda: DataTypeMap.arrow(pa.list_(pa.int8())), lambda: DataTypeMap.sql(SqlType.ARRAY)):
        with pytest.raises(NotImplementedError):
            bad()
    with pytest.raises(ValueError):
        DataType.from_arrow_str("complex")
    assert len(SqlType) == 48 and DFSchema.empty().field_names() == []
    schema = SqlSchema("s")
    schema.add_table(SqlTable("t", [], 3.0))
    assert schema.table_by_name("t").statistics.row_count == 3.0
    schema.drop_table("t")
    assert schema.table_by_name("t") is None


def test_expressions():
    e = (col("a") + 1 > lit(3)) & ~col("b").is_null()
    assert isinstance(e, BinaryExpr) and e.rex_type() is RexType.Call and e.rex_call_operator() == "AND"
    assert e.types().sql_type is SqlType.BOOLEAN and (col("a") / 2).types().arrow_type.data_type == pa.float64()
    assert col("t.a").relation() == "t" and col("t.a").name() == "a" and col("a").rex_type() is RexType.Reference
    assert lit(5).python_value() == 5 and Literal(None).value_i64() is None and lit(pa.scalar(2, pa.int8())).data_type() == "Int8"
    with pytest.raises(TypeError):
        lit("x").value_i32()
    c = case(col("a")).when(lit(1), "one").otherwise("many")
    assert isinstance(c, Case) and len(c.rex_call_operands()) == 3 and c.rex_call_operator() == "case"
    assert Between(col("a"), lit(1), lit(2)).rex_call_operator() == "between" and Like(col("a"), lit("x"), True).rex_call_operator() == "not like"
    assert IsNull(col("a")).variant_name() == "IsNull" and col("a").alias("z").schema_name() == "z"
    with pytest.raises(RuntimeError):
        col("a").sort().to_variant()
    frame = WindowFrame("rows", 2, None)
    assert frame.get_lower_bound().is_preceding() and frame.get_upper_bound().is_unbounded() and frame.get_frame_units() == "ROWS"
    with pytest.raises(NotImplementedError):
        WindowFrame("groups", None, 1)


def test_plans(ctx):
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    plan = larkspur.table_scan("t", schema, ["a"]).filter(col("a") > 1).project([col("a").alias("z")]).sort([col("z").sort(False)]).build()
    assert plan.display_indent().splitlines()[0].startswith("Sort:") and plan.display_graphviz().startswith("digraph")
    scan = plan.inputs()[0].inputs()[0].inputs()[0]
    assert scan.table_name() == "t" and scan.projection() == [(0, "a")] and plan.to_variant() is plan
    ctx.register_record_batches("t", [[pa.record_batch({"a": [1, 2, 3], "b": ["x", "y", "z"]})]])
    assert [r.z for r in plan.to_df(ctx.spark).collect()] == [3, 2]
    parsed = ctx.parse("SELECT b, count(*) AS n FROM t WHERE a > 1 GROUP BY b", larkspur.ContextProvider({"t": schema}))
    assert "Aggregate" in parsed.display_indent() and "Filter" in parsed.display_indent()
    assert "Aggregate" in ctx.optimize(parsed).display_indent()
    from larkspur.errors import ParsingException

    with pytest.raises(ParsingException):
        ctx.parse("SELECT * FROM nowhere", larkspur.ContextProvider({}))
    with pytest.raises(ValueError):
        larkspur.table_scan("t", schema, ["nope"])


def test_modules(spark):
    from larkspur import builder, expr, optimizer, parser

    plan = parser.parse_sql("SELECT 1 AS a", larkspur.ContextProvider({}))
    assert optimizer.optimize_plan(plan, larkspur.OptimizerContext()).field_names() == ["a"]
    assert builder.table_scan is larkspur.table_scan and expr.Aggregate.__name__ == "Aggregate"
    with pytest.raises(AttributeError):
        expr.absent  # noqa: B018

    class Keep(larkspur.OptimizationRule):
        def try_optimize(self, plan):
            return larkspur.LogicalPlanBuilder(plan).filter(col("a") > 5).build()

    scan = larkspur.table_scan("t", pa.schema([("a", pa.int64())])).build()
    assert "Filter" in larkspur.optimize_plan(scan, rules=[Keep()]).display_indent()
