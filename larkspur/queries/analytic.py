"""Aggregation and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.queries.registry import query, sql_query

_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18, 2))) AS DOUBLE)"

sql_query(
    "a1_group_by",
    f"SELECT l_returnflag, l_linestatus, {_MONEY.format('l_quantity')} AS sum_qty, {_MONEY.format('l_extendedprice')} AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
sql_query("a2_global_aggregate", f"SELECT count(*) AS n, {_MONEY.format('o_totalprice')} AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
sql_query("a3_distinct_aggregates", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS keys, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
sql_query("a4_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql_query("a5_ordered_set", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql_query("a5_percentile_within_group", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q1 FROM orders GROUP BY o_orderstatus")
sql_query("a6_grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(grouping(o_orderstatus) AS INT) AS gs, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
sql_query("a6_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
sql_query("a6_cube", "SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size < 4 GROUP BY CUBE (p_brand, p_size)")
sql_query("a7_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 14")
sql_query(
    "a8_general",
    "SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, min(c_name) AS lo, max(c_name) AS hi, round(median(c_acctbal), 4) AS med, bool_and(c_acctbal > -999) AS every_one, bool_or(c_acctbal > 9990) AS any_one FROM customer GROUP BY c_mktsegment",
)
sql_query("a8_bits", "SELECT c_mktsegment, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM customer GROUP BY c_mktsegment")


@query("a8_array_agg", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys, min(n_nationkey) AS first_key, max(n_nationkey) AS last_key, CAST(nth_value AS INT) AS second FROM (SELECT *, nth_value(n_nationkey, 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth_value FROM nation) GROUP BY n_regionkey, nth_value")
def _(ctx):
    keys = F.array_sort(F.collect_list("n_nationkey"))
    return ctx.table("nation").df.groupBy("n_regionkey").agg(
        F.array_join(keys, ",").alias("keys"), F.element_at(keys, 1).alias("first_key"), F.element_at(keys, -1).alias("last_key"), F.try_element_at(keys, F.lit(2)).alias("second")
    )


sql_query(
    "a9_statistics",
    "SELECT c_mktsegment, round(var_samp(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp, round(stddev_samp(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS sp, round(corr(c_acctbal, c_custkey), 8) AS r, round(covar_samp(c_acctbal, c_custkey), 2) AS cs, round(covar_pop(c_acctbal, c_custkey), 2) AS cp FROM customer GROUP BY c_mktsegment",
)
sql_query(
    "a9_regression",
    "SELECT c_mktsegment, round(regr_slope(c_acctbal, c_custkey), 8) AS slope, round(regr_intercept(c_acctbal, c_custkey), 4) AS intercept, round(regr_r2(c_acctbal, c_custkey), 8) AS r2, CAST(regr_count(c_acctbal, c_custkey) AS BIGINT) AS n, round(regr_avgx(c_acctbal, c_custkey), 4) AS ax, round(regr_avgy(c_acctbal, c_custkey), 4) AS ay, round(regr_sxx(c_acctbal, c_custkey), 0) AS sxx, round(regr_syy(c_acctbal, c_custkey), 0) AS syy, round(regr_sxy(c_acctbal, c_custkey), 0) AS sxy FROM customer GROUP BY c_mktsegment",
)
sql_query("a5_array_agg_order", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), ',') AS names, string_agg(n_name, '|' ORDER BY n_nationkey DESC) FILTER (WHERE n_nationkey > 4) AS some FROM nation GROUP BY n_regionkey")
sql_query(
    "a10_approx_distinct",
    "SELECT count(DISTINCT o_custkey) AS n, abs(approx_distinct(o_custkey) / count(DISTINCT o_custkey) - 1) < 0.1 AS near, abs(approx_median(o_totalprice) / median(o_totalprice) - 1) < 0.01 AS near_median, abs(approx_percentile_cont(o_totalprice, 0.9) / percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) - 1) < 0.01 AS near_p90 FROM orders",
    "SELECT count(DISTINCT o_custkey) AS n, true AS near, true AS near_median, true AS near_p90 FROM orders",
)


@query("a10_weighted_percentile", "SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS p50 FROM (SELECT p_brand, p_retailprice, unnest(range(p_size)) AS i FROM part) GROUP BY p_brand")
def _(ctx):
    from larkspur.functions import call

    return ctx.table("part").df.groupBy("p_brand").agg(call("approx_percentile_cont_with_weight", F.col("p_retailprice"), F.col("p_size"), 0.5).alias("p50"))


# Windows

sql_query("n3_rows_frame", "SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM customer")
sql_query("n4_range_frame", "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS BIGINT) AS n FROM customer")
sql_query("n4_interval_range", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")


@query("n5_groups_frame", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def _(ctx):
    from larkspur.operators import groups_frame

    return groups_frame(ctx.table("orders").df, lambda: F.sum("o_orderkey"), ["o_custkey"], [F.col("o_orderpriority").asc_nulls_last()], 1, 0, "s").select("o_orderkey", "s")


sql_query(
    "n5_groups_sql",
    "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders WHERE o_orderkey % 3 > 0",
)
sql_query(
    "n7_ranking",
    "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, CAST(ntile(3) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
)
sql_query(
    "n8_analytic",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS first_one, last_value(o_orderkey) OVER w AS last_one, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
sql_query(
    "n8_ignore_nulls",
    "SELECT n_nationkey, last_value(nullif(n_nationkey % 3, 1)) IGNORE NULLS OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM nation",
    "SELECT n_nationkey, last_value(nullif(n_nationkey % 3, 1) IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM nation",
)
sql_query("n9_aggregate_windows", "SELECT c_custkey, CAST(max(c_custkey) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS hi, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer")


@query("n1_window_node", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer")
def _(ctx):
    from larkspur import col
    from larkspur.expr import ScalarFunction, WindowExpr

    rn = WindowExpr(ScalarFunction("row_number", []), [col("c_nationkey")], [col("c_acctbal").sort(False, True), col("c_custkey").sort()])
    return ctx.table("customer").df.select("c_custkey", rn.to_column().cast("bigint").alias("rn"))


# User-defined functions


@query("f1_scalar_udf", "SELECT c_custkey, c_custkey * 2 + 1 AS y FROM customer")
def _(ctx):
    import pyarrow as pa
    import pyarrow.compute as pc

    from larkspur import udf

    ctx.register_udf(udf(lambda x: pc.add(pc.multiply(x, 2), 1), [pa.int64()], pa.int64(), "immutable", "double_plus_one"))
    return ctx.sql("SELECT c_custkey, double_plus_one(c_custkey) AS y FROM customer")


@query("f2_aggregate_udf", "SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_nationkey")
def _(ctx):
    from larkspur.queries.functions_of_users import total

    ctx.register_udaf(total())
    return ctx.sql("SELECT c_nationkey, int_total(c_custkey) AS total FROM customer GROUP BY c_nationkey")


@query("f2_aggregate_udf_two_phase", "SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def _(ctx):
    from larkspur.queries.functions_of_users import total

    return total().aggregate(ctx.table("lineitem").df, ["l_returnflag"], ["l_partkey"], "total")


@query("f3_window_udf", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS running FROM nation")
def _(ctx):
    from larkspur.queries.functions_of_users import running

    ctx.register_udwf(running())
    return ctx.sql("SELECT n_nationkey, running_total(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS running FROM nation")


@query("f3_window_udf_frame", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM nation")
def _(ctx):
    from larkspur.queries.functions_of_users import framed

    ctx.register_udwf(framed())
    return ctx.sql("SELECT n_nationkey, frame_total(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM nation")


@query("f3_window_udf_rank", "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders")
def _(ctx):
    from larkspur.queries.functions_of_users import ranked

    ctx.register_udwf(ranked())
    return ctx.sql("SELECT o_orderkey, peer_rank(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r FROM orders")


@query("f5_udf_expressions", "SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY c_mktsegment")
def _(ctx):
    from larkspur import col
    from larkspur.queries.functions_of_users import total

    return ctx.table("customer").df.groupBy("c_mktsegment").agg(total()(col("c_custkey")).to_column().alias("total"))
