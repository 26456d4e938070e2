"""Semantics with nulls, repeats, NaN and ties, where Spark's defaults differ."""

from __future__ import annotations

import pyarrow as pa
import pytest

from larkspur import DataFrame
from larkspur.functions.natives import hash_strings
from larkspur.sqlshim import rewrite


@pytest.fixture
def dup(ctx):
    ctx.register_record_batches("dup", [[pa.record_batch({"a": pa.array([1, 1, 2, None, None], pa.int32()), "b": ["x", "x", "y", "z", "z"]})]])
    ctx.register_record_batches("one", [[pa.record_batch({"a": pa.array([1, None], pa.int32()), "b": ["x", "z"]})]])
    ctx.register_record_batches("pairs", [[pa.record_batch({"a": pa.array([1, None, 3, 2, None], pa.int32()), "b": pa.array([None, 1, 2, 3, None], pa.int32())})]])
    return ctx


def test_set_operations(dup):
    left, right = dup.table("dup"), dup.table("one")
    assert sorted(r["b"] for r in left.intersect(right).to_pylist()) == ["x", "x", "z", "z"]
    assert left.except_all(right).to_pylist() == [{"a": 2, "b": "y"}]
    assert left.union(right).count() == 7 and left.union(right, distinct=True).count() == 3 and left.distinct().count() == 3


def test_greatest_least(dup):
    rows = dup.sql("SELECT greatest(a, b) AS g, least(a, b) AS l FROM pairs").to_pylist()
    assert [r["g"] for r in rows] == [None, 1, 3, 3, None] and [r["l"] for r in rows] == [None, 1, 2, 2, None]
    assert dup.sql("SELECT greatest(1, NULL, 3) AS g, least(4) AS l").to_pylist() == [{"g": 3, "l": 4}]


def test_hash_int(dup):
    want = [-4800647303603446203, -9047592728348764295, -9182775566590913511, -3655072017361917197, 6324828959604139914]
    assert hash_strings(pa.array([None, "", "a", "hello", "Setosa"])).to_pylist() == want
    assert dup.sql("SELECT hash_int('hello') AS h, hash_int(CAST(NULL AS STRING)) AS n").to_pylist() == [{"h": want[3], "n": want[0]}]


def test_null_order(dup):
    assert [r["a"] for r in dup.sql("SELECT a FROM dup ORDER BY a").to_pylist()] == [1, 1, 2, None, None]
    assert [r["a"] for r in dup.sql("SELECT a FROM dup ORDER BY a DESC").to_pylist()] == [None, None, 2, 1, 1]
    assert rewrite("SELECT 'order by a' FROM t ORDER BY x, f(y, z) DESC LIMIT 3") == "SELECT 'order by a' FROM t ORDER BY x NULLS LAST, f(y, z) DESC NULLS FIRST LIMIT 3"


def test_shim():
    assert rewrite("SELECT \"A b\" ~ 'x~*'") == "SELECT `A b` RLIKE 'x~*'"
    assert "NOT RLIKE '(?i)x'" in rewrite("SELECT a !~* 'x'")
    assert rewrite("SELECT concat(a, 'x(y)')") == "SELECT concat_ws('', (a) || '', ('x(y)') || '')"
    assert "/* a ~ 'b' */" in rewrite("SELECT 1 /* a ~ 'b' */")
    with pytest.raises(ValueError):
        rewrite("SELECT sum(a) OVER (ORDER BY b GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t JOIN u ON t.a = u.a")


def test_groups_frame(spark):
    from pyspark.sql import functions as F

    from larkspur.operators import groups_frame

    df = spark.createDataFrame([(1,), (2,), (2,), (5,)], "a int")
    assert [r.s for r in groups_frame(df, lambda: F.sum("a"), [], [F.col("a")], 1, 0, "s").orderBy("a").collect()] == [1, 5, 5, 9]


def test_joins(dup):
    out = dup.table("dup").join(dup.table("one"), (["a"], ["a"]), "inner")
    assert out.count() == 2 and out.schema().names == ["a", "b", "a", "b"]
    assert dup.table("dup").join(dup.table("one"), (["a"], ["a"]), "anti").count() == 3
    with pytest.raises(ValueError):
        dup.table("dup").join(dup.table("one"), (["a"], ["a"]), "sideways")
    with pytest.raises(TypeError):
        dup.table("dup")[3]


def test_describe_and_exports(dup):
    d = {r["describe"]: r["a"] for r in dup.table("dup").describe().to_pylist()}
    assert d["count"] == "3.0" and d["null_count"] == "2.0" and d["median"] == "1.0" and set(d) == {"count", "null_count", "mean", "std", "min", "max", "median"}
    frame = dup.table("dup")
    assert frame.to_pydict()["b"] == ["x", "x", "y", "z", "z"] and frame.to_pandas().shape == (5, 2)
    assert sum(b.to_pyarrow().num_rows for b in frame.execute_stream(batch_rows=2)) == 5
    assert sum(b.to_pyarrow().num_rows for s in frame.execute_stream_partitioned() for b in s) == 5
    assert sum(b.num_rows for p in frame.repartition(3).collect_partitioned() for b in p) == 5
    assert frame.cache().count() == 5 and frame.execution_plan().partition_count >= 1 and "DataFrame()" in repr(frame)
    assert isinstance(frame.limit(2, offset=1), DataFrame) and frame.limit(9, offset=3).count() == 2


@pytest.fixture
def kv(ctx):
    ctx.register_record_batches("kv", [[pa.record_batch({"k": pa.array([i % 5 for i in range(20)], pa.int32()), "v": pa.array(range(20), pa.int32()), "groups": pa.array([i // 4 for i in range(20)], pa.int32())})]])
    return ctx


def test_distinct_on_keeps_the_order(kv):
    """The block's ORDER BY holds for the result, so that LIMIT takes its first rows; in CTEs, subqueries and unions too."""
    rows = lambda q: [tuple(r.values()) for r in kv.sql(q).to_pylist()]
    assert rows("SELECT DISTINCT ON (k) k, v FROM kv ORDER BY k DESC, v DESC LIMIT 3") == [(4, 19), (3, 18), (2, 17)]
    assert rows("SELECT DISTINCT ON (k) k AS key, v + 1 AS w FROM kv ORDER BY key DESC, w LIMIT 2 OFFSET 1") == [(3, 4), (2, 3)]
    assert rows("WITH d AS (SELECT DISTINCT ON (k) k, v FROM kv ORDER BY k, v DESC) SELECT k, v FROM d WHERE v > 16 ORDER BY k") == [(2, 17), (3, 18), (4, 19)]
    assert rows("SELECT sum(v) AS s FROM (SELECT DISTINCT ON (k) v FROM kv ORDER BY k, v) AS t") == [(10,)]
    assert sorted(rows("SELECT DISTINCT ON (k) k, k AS x FROM kv WHERE v < 2 UNION ALL SELECT DISTINCT ON (groups) groups, 9 FROM kv WHERE groups = 4")) == [(0, 0), (1, 1), (4, 9)]
    assert rows("SELECT DISTINCT ON (k) k, count(*) AS n FROM kv GROUP BY k ORDER BY k LIMIT 1") == [(0, 4)]
    assert rows("SELECT DISTINCT ON (k, groups) * FROM kv WHERE v < 2 ORDER BY k, groups") == [(0, 0, 0), (1, 1, 0)]
    assert rows("SELECT DISTINCT ON (k) v FROM kv ORDER BY 1 LIMIT 1") == [(0,)]


def test_ordered_aggregates(kv):
    one = lambda q: list(kv.sql(q).to_pylist()[0].values())
    assert one("SELECT array_agg(v ORDER BY k DESC, v) AS a FROM kv WHERE v < 7") == [[4, 3, 2, 1, 6, 0, 5]]
    assert one("SELECT array_agg(nullif(v, 3) ORDER BY nullif(v, 3) DESC) AS a, array_agg(nullif(v, 3) ORDER BY nullif(v, 3) NULLS FIRST) AS b FROM kv WHERE v < 5") == [[None, 4, 2, 1, 0], [None, 0, 1, 2, 4]]
    assert one("SELECT string_agg(CAST(v AS STRING), '-' ORDER BY v DESC) FILTER (WHERE v > 1) AS s, array_agg(DISTINCT k ORDER BY k DESC) FILTER (WHERE v > 2) AS d FROM kv WHERE v < 5") == ["4-3-2", [4, 3]]
    assert one("SELECT first_value(v ORDER BY v DESC) AS f, last_value(v ORDER BY v DESC) AS l, nth_value(v, 2 ORDER BY v) AS n FROM kv") == [19, 0, 1]
    assert kv.sql("SELECT k, array_agg(v ORDER BY v DESC) AS a FROM kv GROUP BY k ORDER BY k LIMIT 1").to_pylist() == [{"k": 0, "a": [15, 10, 5, 0]}]


def test_groups_frames_in_sql(kv):
    rows = lambda q: [tuple(r.values()) for r in kv.sql(q).to_pylist()]
    kv.register_record_batches("peers", [[pa.record_batch({"a": pa.array([1, 2, 2, 5], pa.int32())})]])
    assert rows("SELECT a, sum(a) OVER (ORDER BY a GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM peers ORDER BY a") == [(1, 1), (2, 5), (2, 5), (5, 9)]
    assert rows("SELECT p.*, count(*) OVER (PARTITION BY 1 ORDER BY p.a DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS n FROM peers AS p WHERE p.a > 1 ORDER BY a") == [(2, 3), (2, 3), (5, 3)]
    assert rows("SELECT max(s) AS m FROM (SELECT sum(a) OVER (ORDER BY a GROUPS 1 PRECEDING) AS s FROM peers) AS t") == [(9,)]
    assert rows("SELECT groups FROM kv WHERE groups BETWEEN 1 AND 1 AND v = 4") == [(1,)]
    assert rows("SELECT v FROM kv WHERE v < 2 EXCEPT SELECT 0 FROM kv") == [(1,)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_date_bin_knows_no_zone(ctx, zone):
    from pyspark.sql import functions as F

    from larkspur.functions import call

    before = ctx.spark.conf.get("spark.sql.session.timeZone")
    ctx.spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = lambda t: f"timestamp_ntz'{t}'"
        cases = [
            ("1 day", "2024-01-02 03:00:00", None, "2024-01-02 00:00:00"), ("15 minutes", "2024-03-10 02:37:59.5", None, "2024-03-10 02:30:00"), ("1 week", "2024-01-02 03:00:00", "2024-01-01", "2024-01-01 00:00:00"),
            ("1 month", "2024-02-29 23:59:59", None, "2024-02-01 00:00:00"), ("3 months", "1969-12-31 23:00:00", None, "1969-10-01 00:00:00"), ("1 month", "2024-03-14 00:00:00", "2020-01-15", "2024-02-15 00:00:00"),
            ("1 year", "2024-05-01 00:00:00", "2000-07-01 12:00:00", "2023-07-01 12:00:00"), ("2 hours 30 minutes", "1969-12-31 23:00:00", None, "1969-12-31 21:30:00"), ("250 milliseconds", "2024-01-01 00:00:00.6", None, "2024-01-01 00:00:00.5"),
        ]
        for length, ts, origin, want in cases:
            sql = f"date_bin(INTERVAL '{length}', {at(ts)}{', ' + at(origin) if origin else ''})"
            column = call("date_bin", length, F.expr(at(ts)), *([origin] if origin else []))
            assert ctx.sql(f"SELECT CAST({sql} AS STRING) AS b").to_pylist() == [{"b": want}]
            assert ctx.spark.range(1).select(column.cast("string").alias("b")).first().b == want
        assert ctx.sql("SELECT date_bin(INTERVAL '1 day', CAST(NULL AS TIMESTAMP)) AS b").to_pylist() == [{"b": None}]
    finally:
        ctx.spark.conf.set("spark.sql.session.timeZone", before)


def test_concat_of_arrays_and_texts(kv):
    assert kv.sql("SELECT concat(array(1), array(2, 3)) AS a, concat('x', NULL, 4) AS s, concat(array('a'), array(concat('b', 'c'))) AS t").to_pylist() == [{"a": [1, 2, 3], "s": "x4", "t": ["a", "bc"]}]


def test_statements_and_rules(ctx):
    from larkspur.plans import ContextProvider, OptimizationRule, optimize_plan, parse_sql
    from larkspur.plans import nodes

    provider = ContextProvider({"t": pa.schema([("a", pa.int64())])})
    plan = parse_sql("SELECT a FROM t WHERE a > 1 -- 'x;y'\n AND ';' <> 'a'; SELECT 2", provider, spark=ctx.spark)
    assert "2" not in repr(plan).splitlines()[0]

    class Shorter(OptimizationRule):
        def try_optimize(self, plan):
            return nodes.Limit(0, 3, plan) if hasattr(nodes, "Limit") else plan

    assert "imit" in repr(optimize_plan(parse_sql("SELECT a FROM t", provider, spark=ctx.spark), rules=[Shorter()], spark=ctx.spark))
