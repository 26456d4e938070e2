"""Projection, joins, set operations, limits: the DataFrame interface, and SQL forms beyond it."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.queries.registry import query, sql_query

# Catalog and sources


@query("k2_table", "SELECT * FROM nation")
def _(ctx):
    return ctx.table("nation")


@query("k10_register_table", "SELECT * FROM region")
def _(ctx):
    ctx.register_table("region_alias", ctx.catalog().database().table("region"))
    return ctx.table("region_alias")


@query("k11_register_dataframe", "SELECT c_custkey, c_name FROM customer")
def _(ctx):
    ctx.register_dataframe("customer_names", ctx.table("customer").select_columns("c_custkey", "c_name"))
    return ctx.sql("SELECT * FROM customer_names")


@query("s1_parquet_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def _(ctx):
    return ctx.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")


@query("s12_table_scan_with_filters", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _(ctx):
    from larkspur import col, table_scan_with_filters

    plan = table_scan_with_filters("customer", ctx.table("customer").schema(), [col("c_acctbal") > 5000], ["c_custkey", "c_acctbal"]).build()
    return plan.to_df(ctx.spark)


@query("p18_plan_builder", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def _(ctx):
    from larkspur import col, table_scan

    plan = table_scan("part", ctx.table("part").schema()).filter(col("p_size") > 25).project([col("p_partkey"), col("p_brand")]).sort([col("p_partkey").sort()]).build()
    return plan.to_df(ctx.spark)


# Frame operators


@query("r1_select_columns", "SELECT c_name, c_acctbal FROM customer")
def _(ctx):
    return ctx.table("customer")["c_name", "c_acctbal"]


@query("r2_with_column_renamed", "SELECT n_nationkey, n_name AS nation_name, n_regionkey FROM nation")
def _(ctx):
    return ctx.table("nation").with_column_renamed("n_name", "nation_name").with_column_renamed("absent", "x")


@query("r3_limit_offset", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def _(ctx):
    return ctx.sql("SELECT * FROM customer ORDER BY c_custkey").limit(20, offset=10)


@query("r4_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(ctx):
    return ctx.table("orders").select_columns("o_orderstatus", "o_orderpriority").distinct()


@query(
    "r5_describe",
    """SELECT 'count' AS describe, CAST(CAST(count(p_size) AS DOUBLE) AS VARCHAR) AS p_size FROM part
       UNION ALL SELECT 'null_count', CAST(CAST(count(*) - count(p_size) AS DOUBLE) AS VARCHAR) FROM part
       UNION ALL SELECT 'min', CAST(min(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'max', CAST(max(p_size) AS VARCHAR) FROM part
       UNION ALL SELECT 'median', CAST(CAST(median(p_size) AS DOUBLE) AS VARCHAR) FROM part""",
)
def _(ctx):
    return ctx.table("part").select_columns("p_size").describe().df.where("describe NOT IN ('mean', 'std')")


@query("r6_repartition", "SELECT o_orderkey, o_custkey FROM orders")
def _(ctx):
    return ctx.table("orders").select_columns("o_orderkey", "o_custkey").repartition(4)


@query("w4_collect_rows", "SELECT r_regionkey, r_name FROM region")
def _(ctx):
    import pyarrow as pa

    ctx.register_record_batches("region_again", [pa.Table.from_batches(ctx.table("region").collect()).to_batches()])
    return ctx.table("region_again")


@query("w8_count", "SELECT count(*) AS n FROM lineitem")
def _(ctx):
    return ctx.table("lineitem").df.agg(F.count("*").alias("n"))


# Joins

for _id, _how, _sql in (
    ("j1_inner_join", "inner", "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    ("j2_left_join", "left", "SELECT * FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    ("j3_right_join", "right", "SELECT * FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey"),
    ("j4_full_join", "full", "SELECT * FROM customer FULL JOIN nation ON c_nationkey = n_nationkey"),
    ("j5_semi_join", "semi", "SELECT * FROM customer SEMI JOIN nation ON c_nationkey = n_nationkey"),
    ("j6_anti_join", "anti", "SELECT * FROM customer ANTI JOIN nation ON c_nationkey = n_nationkey"),
):
    _side = "(SELECT * FROM nation WHERE n_nationkey < 15)"
    query(_id, _sql.replace("JOIN nation", f"JOIN {_side} n"))(
        lambda ctx, how=_how: ctx.table("customer").join(ctx.sql("SELECT * FROM nation WHERE n_nationkey < 15"), (["c_nationkey"], ["n_nationkey"]), how)
    )


@query("j7_multi_key_join", "SELECT * FROM customer JOIN supplier ON c_nationkey = s_nationkey AND substr(c_name, 1, 0) = substr(s_name, 1, 0) WHERE s_suppkey <= 20")
def _(ctx):
    left = ctx.table("customer").df.withColumn("k", F.substring("c_name", 1, 0))
    right = ctx.table("supplier").df.where("s_suppkey <= 20").withColumn("k2", F.substring("s_name", 1, 0))
    from larkspur import DataFrame

    return DataFrame(left).join(DataFrame(right), (["c_nationkey", "k"], ["s_nationkey", "k2"]), "inner").df.drop("k", "k2")


sql_query("j8_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query(
    "j9_null_equal_join",
    "SELECT a.k AS a, b.k AS b, a.n_nationkey AS n FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) a JOIN (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k",
)
sql_query("j10_using_join", "SELECT o_custkey, c_name, o_orderkey FROM orders JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) c USING (o_custkey)")
sql_query("j11_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("j11_natural_join", "SELECT * FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
sql_query("j12_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("j12_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("j12_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql_query("j12_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql_query("j13_scalar_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("j14_lateral_join", "SELECT n_name, t.best FROM nation n, LATERAL (SELECT max(c_acctbal) AS best FROM customer c WHERE c.c_nationkey = n.n_nationkey) t")
sql_query("j15_join_strategies", "SELECT /*+ MERGE(o) */ c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment")

# Set operations; nulls come from nullif, as the tables have none

_A = "SELECT nullif(c_nationkey, 3) AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0"
_B = "SELECT nullif(c_nationkey, 3) AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 9"


def _pair(ctx):
    return ctx.sql(_A), ctx.sql(_B)


@query("u1_union", f"{_A} UNION ALL {_B}")
def _(ctx):
    a, b = _pair(ctx)
    return a.union(b)


@query("u2_union_distinct", f"{_A} UNION {_B}")
def _(ctx):
    a, b = _pair(ctx)
    return a.union_distinct(b)


_MATCH = f"SELECT 1 FROM ({_B}) b WHERE a.k IS NOT DISTINCT FROM b.k AND a.s IS NOT DISTINCT FROM b.s"


@query("u3_intersect", f"SELECT * FROM ({_A}) a WHERE EXISTS ({_MATCH})")
def _(ctx):
    a, b = _pair(ctx)
    return a.intersect(b)


@query("u4_except_all", f"SELECT * FROM ({_A}) a WHERE NOT EXISTS ({_MATCH})")
def _(ctx):
    a, b = _pair(ctx)
    return a.except_all(b)


sql_query("u5_sql_union", f"{_A} UNION {_B}")
sql_query("u5_sql_intersect", f"{_A} INTERSECT {_B}")
sql_query("u5_sql_except", f"{_A} EXCEPT {_B}")
sql_query("u5_sql_intersect_all", f"{_A} INTERSECT ALL {_B}")
sql_query("u5_sql_except_all", f"{_A} EXCEPT ALL {_B}")

# Sorting and limits

_TOP = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15"
sql_query("t1_order_by", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey ASC NULLS FIRST")
sql_query(
    "t2_null_order", "SELECT k, n FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM nation) ORDER BY k, n LIMIT 22",
    "SELECT k, n FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM nation) ORDER BY k NULLS LAST, n LIMIT 22",
)
sql_query(
    "t2_null_order_desc", "SELECT k, n FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM nation) ORDER BY k DESC, n LIMIT 7",
    "SELECT k, n FROM (SELECT nullif(n_regionkey, 1) AS k, n_nationkey AS n FROM nation) ORDER BY k DESC NULLS FIRST, n LIMIT 7",
)
sql_query("t3_top_k", _TOP)
sql_query("t4_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
sql_query(
    "p9_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey DESC",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
)

# SQL forms

sql_query("q1_sql", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql_query("q5_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, CAST(n AS BIGINT) AS n FROM per JOIN customer ON c_custkey = o_custkey")
sql_query("q5_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query("q5_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (CAST(NULL AS INT), 'z')) AS v(a, b)")
sql_query("q5_derived_table", "SELECT seg, CAST(count(*) AS BIGINT) AS n FROM (SELECT upper(c_mktsegment) AS seg FROM customer WHERE c_acctbal > 0) s GROUP BY seg")
sql_query("e19_wildcard", "SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")


@query("q6_view", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _(ctx):
    ctx.sql("CREATE OR REPLACE TEMP VIEW nations_of_two AS SELECT n_name FROM nation WHERE n_regionkey = 2")
    return ctx.table("nations_of_two")


@query("q8_prepared_statement", "SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5")
def _(ctx):
    ctx.sql("PREPARE by_region AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2")
    return ctx.sql("EXECUTE by_region(3, 5)")


@query("q7_information_schema", "SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name")
def _(ctx):
    return ctx.sql("SELECT table_name, column_name FROM information_schema.columns WHERE table_name = 'nation'")


@query("s4_record_batches", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def _(ctx):
    ctx.register_record_batches("nation_batches", [[b] for b in ctx.table("nation").to_arrow_table().to_batches(max_chunksize=9)])
    return ctx.sql("SELECT n_nationkey, n_name FROM nation_batches WHERE n_nationkey >= 10")


@query("s5_record_batch_reader", "SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def _(ctx):
    from larkspur import col

    ctx.register_record_batch_reader("region_reader", ctx.table("region").to_arrow_table().to_reader(), [col("r_regionkey").sort()])
    return ctx.sql("SELECT r_name FROM region_reader UNION ALL SELECT r_name FROM region_reader")


@query("s10_table_provider", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey >= 4")
def _(ctx):
    from larkspur.queries.providers import Rows

    ctx.register_table_provider("nation_provider", Rows(ctx.table("nation").to_arrow_table()))
    return ctx.sql("SELECT n_name FROM nation_provider WHERE n_regionkey IN (1, 3) AND n_nationkey >= 4")


sql_query("p9_distinct_on_limit", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 20")
sql_query(
    "p9_distinct_on_subquery",
    "WITH latest AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderpriority AS p FROM orders ORDER BY o_custkey, o_orderkey DESC) SELECT p, count(*) AS n, max(d.k) AS k FROM latest JOIN (SELECT DISTINCT ON (c_nationkey) c_custkey AS k FROM customer ORDER BY c_nationkey, c_custkey) AS d ON d.k >= o_custkey GROUP BY p",
)
