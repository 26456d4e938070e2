"""Expressions and scalar functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.queries.registry import query, sql_query

# Expressions, through the expression tree


def _select(ctx, table, *exprs):
    return ctx.table(table).df.select(*(e.to_column() for e in exprs))


@query("e1_column_literal_alias", "SELECT n_name AS name, 7 AS seven, 'x' AS x FROM nation")
def _(ctx):
    from larkspur import col, lit

    return _select(ctx, "nation", col("n_name").alias("name"), lit(7).alias("seven"), lit("x").alias("x"))


@query("e2_comparisons", "SELECT c_custkey, c_custkey < 10 AS lt, c_custkey <= 10 AS le, c_custkey = 10 AS eq, c_custkey <> 10 AS ne, c_custkey > 10 AS gt, c_custkey >= 10 AS ge FROM customer")
def _(ctx):
    from larkspur import col

    k = col("c_custkey")
    return _select(ctx, "customer", k, (k < 10).alias("lt"), (k <= 10).alias("le"), (k == 10).alias("eq"), (k != 10).alias("ne"), (k > 10).alias("gt"), (k >= 10).alias("ge"))


@query("e3_arithmetic", "SELECT l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * 3 AS m, round(l_extendedprice / l_quantity, 6) AS d, l_orderkey % 7 AS r FROM lineitem")
def _(ctx):
    from larkspur import col, function

    o, p = col("l_orderkey"), col("l_partkey")
    return _select(ctx, "lineitem", (o + p).alias("a"), (o - p).alias("s"), (o * 3).alias("m"), function("round", col("l_extendedprice") / col("l_quantity"), 6).alias("d"), (o % 7).alias("r"))


@query("e4_boolean", "SELECT c_custkey FROM customer WHERE (c_custkey > 100 AND c_acctbal < 0) OR NOT (c_nationkey > 2)")
def _(ctx):
    from larkspur import col

    test = ((col("c_custkey") > 100) & (col("c_acctbal") < 0)) | ~(col("c_nationkey") > 2)
    return ctx.table("customer").df.where(test.to_column()).select("c_custkey")


sql_query("e5_struct_access", "SELECT s.k AS k, s.v AS v FROM (SELECT named_struct('k', n_nationkey, 'v', n_name) AS s FROM nation)", "SELECT s.k AS k, s.v AS v FROM (SELECT struct_pack(k := n_nationkey, v := n_name) AS s FROM nation)")


@query("e7_is_null", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS NULL")
def _(ctx):
    from larkspur import col, function

    return ctx.table("nation").df.where(function("nullif", col("n_regionkey"), col("n_regionkey") - (col("n_regionkey") - 2)).is_null().to_column()).select("n_nationkey")


@query("e8_cast", "SELECT CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey AS DOUBLE) AS d, TRY_CAST(c_name AS INTEGER) AS t FROM customer")
def _(ctx):
    from larkspur import col
    from larkspur.expr import TryCast

    return _select(ctx, "customer", col("c_custkey").cast(pa.string()).alias("s"), col("c_custkey").cast(pa.float64()).alias("d"), TryCast(col("c_name"), pa.int32()).alias("t"))


sql_query("e9_regex_operators", "SELECT c_name ~ '1$' AS a, c_name ~* 'CUSTOMER.*2$' AS b, c_name !~ '3$' AS c, c_name !~* 'CUSTOMER.*4$' AS d FROM customer", "SELECT regexp_matches(c_name, '1$') AS a, regexp_matches(c_name, 'CUSTOMER.*2$', 'i') AS b, NOT regexp_matches(c_name, '3$') AS c, NOT regexp_matches(c_name, 'CUSTOMER.*4$', 'i') AS d FROM customer")
sql_query("e9_distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey, 1) AS a, nullif(n_regionkey, 1) IS NOT DISTINCT FROM nullif(n_nationkey, 1) AS b FROM nation")
sql_query("e9_bitwise_concat", "SELECT c_custkey & 6 AS a, c_custkey | 9 AS o, shiftleft(c_custkey, 2) AS l, shiftright(c_custkey, 1) AS r, c_name || '-' || c_mktsegment AS s FROM customer", "SELECT c_custkey & 6 AS a, c_custkey | 9 AS o, c_custkey << 2 AS l, c_custkey >> 1 AS r, c_name || '-' || c_mktsegment AS s FROM customer")
sql_query("e10_truth_tests", "SELECT n_nationkey, (b IS TRUE) AS t, (b IS NOT TRUE) AS nt, (b IS FALSE) AS f, (b IS NOT FALSE) AS nf, (b IS NULL) AS u, (b IS NOT NULL) AS nu, -n_nationkey AS neg FROM (SELECT n_nationkey, nullif(n_regionkey, 1) > 2 AS b FROM nation)")


@query("e10_truth_nodes", "SELECT n_nationkey, (b IS TRUE) AS t, (b IS NOT TRUE) AS nt, (b IS FALSE) AS f, (b IS NOT FALSE) AS nf, (b IS NULL) AS u, (b IS NOT NULL) AS nu FROM (SELECT n_nationkey, nullif(n_regionkey, 1) > 2 AS b FROM nation)")
def _(ctx):
    from larkspur import col
    from larkspur.expr import IsFalse, IsNotFalse, IsNotTrue, IsNotUnknown, IsTrue, IsUnknown

    b = col("b")
    df = ctx.sql("SELECT n_nationkey, nullif(n_regionkey, 1) > 2 AS b FROM nation").df
    return df.select("n_nationkey", *(make(b).alias(n).to_column() for make, n in ((IsTrue, "t"), (IsNotTrue, "nt"), (IsFalse, "f"), (IsNotFalse, "nf"), (IsUnknown, "u"), (IsNotUnknown, "nu"))))


sql_query("e11_like", "SELECT c_name LIKE '%1_' AS a, c_name NOT LIKE '%2%' AS b, c_mktsegment ILIKE 'b%g' AS c, replace(c_name, '#', '%') LIKE '%!%0%' ESCAPE '!' AS d FROM customer")
sql_query("e12_similar_to", "SELECT c_name FROM customer WHERE c_name SIMILAR TO '%(1|2)3'", "SELECT c_name FROM customer WHERE regexp_full_match(c_name, '.*(1|2)3')")
sql_query("e13_between", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 900 AND c_custkey NOT BETWEEN 50 AND 1000")
sql_query("e14_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)")


@query("e15_case", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS a, CASE WHEN n_nationkey > 20 THEN 'high' WHEN n_nationkey > 10 THEN 'mid' END AS b FROM nation")
def _(ctx):
    from larkspur import case, col

    k = col("n_nationkey")
    return _select(ctx, "nation", k, case(col("n_regionkey")).when(0, "zero").when(1, "one").otherwise("many").alias("a"), case().when(k > 20, "high").when(k > 10, "mid").end().alias("b"))


sql_query("e6_sort_nulls", "SELECT k FROM (SELECT nullif(n_nationkey % 4, 2) AS k, n_nationkey FROM nation) ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 10")


@query("e17_placeholders", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 1400")
def _(ctx):
    return ctx.sql("SELECT c_custkey FROM customer WHERE c_mktsegment = $1 AND c_custkey > $2", ["BUILDING", 1400])


# Native functions

_N = "(SELECT n_nationkey AS id, nullif(n_nationkey % 5, 3) AS a, nullif(n_regionkey, 1) AS b FROM nation)"
_GREATEST, _LEAST = "CASE WHEN a > b THEN a ELSE b END", "CASE WHEN a < b THEN a ELSE b END"
sql_query("g1_greatest", f"SELECT id, greatest(a, b) AS g, greatest(3, 9, 4) AS c FROM {_N}", f"SELECT id, {_GREATEST} AS g, 9 AS c FROM {_N}")
sql_query("g2_least", f"SELECT id, least(a, b) AS l, least(3, 9, 4) AS c FROM {_N}", f"SELECT id, {_LEAST} AS l, 3 AS c FROM {_N}")
sql_query(
    "g3_greatest_types", "SELECT c_custkey, greatest(c_name, c_mktsegment) AS s, greatest(c_acctbal, 5000.5D) AS d, least(c_custkey, 700L) AS i FROM customer",
    "SELECT c_custkey, greatest(c_name, c_mktsegment) AS s, greatest(c_acctbal, 5000.5) AS d, least(c_custkey, 700) AS i FROM customer",
)
sql_query("g4_hash_int", "SELECT n_name, hash_int(n_name) AS h FROM nation", check=False)

# Inherited functions, one query a family or more

sql_query("h1_conditional", "SELECT id, coalesce(a, b, -1) AS c, ifnull(a, -2) AS i, nullif(id, 5) AS n FROM " + _N)
sql_query("h1_nvl", "SELECT id, nvl(a, -3) AS v, nvl2(a, 1, 0) AS w FROM " + _N, "SELECT id, coalesce(a, -3) AS v, CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END AS w FROM " + _N)
sql_query(
    "h2_math",
    "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 8) AS s, round(cbrt(c_custkey), 8) AS c, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(ln(c_custkey + 1), 8) AS l, round(log10(c_custkey + 1), 8) AS l10, round(log2(c_custkey + 1), 8) AS l2, round(exp(c_custkey / 1e3), 8) AS e, round(power(c_custkey, 2), 2) AS p, CAST(sign(c_acctbal) AS INT) AS sg, round(degrees(1.5), 8) AS dg, round(radians(90), 8) AS rd, round(pi(), 8) AS pi FROM customer",
)
sql_query(
    "h2_trigonometry",
    "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 7) AS t, round(asin(n_nationkey * 1e0 / 25), 9) AS asn, round(acos(n_nationkey * 1e0 / 25), 9) AS acs, round(atan(n_nationkey), 9) AS atn, round(atan2(n_nationkey, 3), 9) AS at2, round(sinh(n_nationkey * 1e0 / 10), 7) AS sh, round(cosh(n_nationkey * 1e0 / 10), 7) AS ch, round(tanh(n_nationkey), 9) AS th, round(asinh(n_nationkey), 9) AS ash, round(acosh(n_nationkey + 1), 9) AS ach, round(atanh(n_nationkey * 1e0 / 26), 9) AS ath, round(cot(n_nationkey + 1), 6) AS ct FROM nation",
)
sql_query("h2_integer_math", "SELECT n_nationkey, gcd(n_nationkey, 18) AS g, lcm(n_nationkey, 6) AS l, factorial(n_nationkey % 15) AS f, iszero(n_regionkey) AS z, CAST(trunc(n_nationkey / 7.0) AS INT) AS t, 17 div 5 AS q FROM nation", "SELECT n_nationkey, CAST(gcd(n_nationkey, 18) AS BIGINT) AS g, CAST(lcm(n_nationkey, 6) AS BIGINT) AS l, CAST(factorial(n_nationkey % 15) AS BIGINT) AS f, n_regionkey = 0 AS z, CAST(trunc(n_nationkey / 7.0) AS INT) AS t, 17 // 5 AS q FROM nation")
sql_query("h2_round_nan", "SELECT c_custkey, round(c_acctbal) AS r0, round(c_acctbal, 1) AS r1, isnan(c_acctbal) AS n FROM customer")
sql_query(
    "h3_strings",
    "SELECT c_custkey, ascii(c_name) AS a, bit_length(c_name) AS bl, char_length(c_name) AS cl, octet_length(c_name) AS ol, concat_ws('-', c_name, c_mktsegment) AS cw, contains(c_name, '12') AS ct, initcap(lower(c_mktsegment)) AS ic, left(c_name, 3) AS le, right(c_name, 3) AS ri, lower(c_name) AS lo, upper(c_name) AS up, lpad(c_name, 25, '*') AS lp, rpad(c_name, 25, '*') AS rp, repeat('ab', 3) AS rep, replace(c_name, '0', 'o') AS rpl, reverse(c_name) AS rev, substr(c_name, 3, 4) AS sub, trim('  x ') AS tr, ltrim('  x ') AS lt, rtrim('  x ') AS rt, translate(c_name, '01', 'ab') AS tl FROM customer",
    "SELECT c_custkey, ascii(c_name) AS a, bit_length(c_name) AS bl, CAST(length(c_name) AS INT) AS cl, CAST(strlen(c_name) AS INT) AS ol, concat_ws('-', c_name, c_mktsegment) AS cw, contains(c_name, '12') AS ct, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, left(c_name, 3) AS le, right(c_name, 3) AS ri, lower(c_name) AS lo, upper(c_name) AS up, lpad(c_name, 25, '*') AS lp, rpad(c_name, 25, '*') AS rp, repeat('ab', 3) AS rep, replace(c_name, '0', 'o') AS rpl, reverse(c_name) AS rev, substr(c_name, 3, 4) AS sub, trim('  x ') AS tr, ltrim('  x ') AS lt, rtrim('  x ') AS rt, translate(c_name, '01', 'ab') AS tl FROM customer",
)
sql_query(
    "h3_strings_more",
    "SELECT c_custkey, split_part(c_name, '#', 2) AS sp, strpos(c_name, '#') AS st, instr(c_name, '0') AS ins, levenshtein(c_name, 'Customer') AS lv, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '7') AS ew, to_hex(c_custkey) AS hx, concat(c_mktsegment, NULL, '!') AS cc, chr(65 + c_nationkey % 26) AS ch, overlay(c_name PLACING 'XX' FROM 2 FOR 3) AS ov, btrim('xxaxx', 'x') AS bt, find_in_set('b', 'a,b,c') AS fs, substring_index('a.b.c', '.', 2) AS si, position('#' IN c_name) AS ps FROM customer",
    "SELECT c_custkey, split_part(c_name, '#', 2) AS sp, CAST(strpos(c_name, '#') AS INT) AS st, CAST(strpos(c_name, '0') AS INT) AS ins, CAST(levenshtein(c_name, 'Customer') AS INT) AS lv, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '7') AS ew, lower(to_hex(c_custkey)) AS hx, concat(c_mktsegment, NULL, '!') AS cc, chr(CAST(65 + c_nationkey % 26 AS INT)) AS ch, c_name[1] || 'XX' || c_name[5:] AS ov, trim('xxaxx', 'x') AS bt, 2 AS fs, 'a.b' AS si, CAST(strpos(c_name, '#') AS INT) AS ps FROM customer",
)
sql_query(
    "h4_hashes",
    "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, encode(c_name, 'hex') AS h, decode(encode(c_name, 'hex'), 'hex') = CAST(c_name AS BINARY) AS same FROM customer",
    "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, true AS same FROM customer",
)


@query("h4_digest", "SELECT c_custkey, lower(md5(c_name)) AS d, to_base64(encode(c_name)) AS b FROM customer")
def _(ctx):
    from larkspur.functions import call

    return ctx.table("customer").df.select("c_custkey", F.lower(F.hex(call("digest", F.col("c_name"), "md5"))).alias("d"), call("encode", F.col("c_name"), "base64").alias("b"))


sql_query(
    "h5_regex", "SELECT c_custkey, regexp_like(c_name, '[0-9]+5') AS l, regexp_count(c_name, '0') AS n, regexp_replace(c_name, '0+', '-') AS r FROM customer",
    "SELECT c_custkey, regexp_matches(c_name, '[0-9]+5') AS l, CAST(len(regexp_extract_all(c_name, '0')) AS INT) AS n, regexp_replace(c_name, '0+', '-', 'g') AS r FROM customer",
)


@query("h5_regexp_match", "SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS digits FROM customer")
def _(ctx):
    from larkspur.functions import call

    return ctx.table("customer").df.select("c_custkey", call("regexp_match", F.col("c_name"), "([A-Za-z]+)#0*([0-9]+)")[1].alias("digits"))


sql_query(
    "h6_dates",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS timestamp_ntz) AS m, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS mo, CAST(extract(dow FROM o_orderdate) - 1 AS BIGINT) AS dow, CAST(to_date(o_orderdate) AS STRING) AS d, CAST(make_date(2020, 2, 29) AS STRING) AS md, to_char(o_orderdate, '%Y/%m/%d') AS f FROM orders",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, date_part('year', o_orderdate) AS y, extract(month FROM o_orderdate) AS mo, extract(dow FROM o_orderdate) AS dow, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(make_date(2020, 2, 29) AS VARCHAR) AS md, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders",
)
sql_query("h6_date_bin", "SELECT event_id, date_bin(INTERVAL '15 minutes', ts) AS b FROM events", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events")
sql_query(
    "h6_date_bin_months", "SELECT o_orderkey, date_bin(INTERVAL '3 months', o_orderdate) AS q, date_bin(INTERVAL '1 week', o_orderdate, timestamp_ntz'2024-01-01') AS w, date_bin(INTERVAL '2 hours 30 minutes', o_orderdate) AS h FROM orders",
    "SELECT o_orderkey, time_bucket(INTERVAL '3 months', o_orderdate) AS q, time_bucket(INTERVAL '1 week', o_orderdate, TIMESTAMP '2024-01-01') AS w, time_bucket(INTERVAL '150 minutes', o_orderdate, TIMESTAMP '1970-01-01') AS h FROM orders",
)
sql_query(
    "h6_epochs", "SELECT o_orderkey, to_unixtime(o_orderdate) AS e, from_unixtime(1000000000 + o_orderkey) AS t, to_timestamp_seconds(o_orderkey) AS s FROM orders",
    "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS e, make_timestamp((1000000000 + o_orderkey) * 1000000) AS t, make_timestamp(o_orderkey * 1000000) AS s FROM orders",
)
_ARR = "(SELECT n_nationkey AS id, array(n_nationkey, n_regionkey, 3, n_regionkey) AS a, array(3, n_regionkey, 40) AS b FROM nation)"
_LIST = "(SELECT n_nationkey AS id, [n_nationkey, n_regionkey, 3, n_regionkey] AS a, [3, n_regionkey, 40] AS b FROM nation)"
_J = "array_to_string({0}, ',')"
sql_query(
    "h7_arrays",
    f"SELECT id, array_contains(a, 3) AS c, array_has_any(a, b) AS ha, array_has_all(a, array(3)) AS hl, array_length(a) AS n, {_J.format('array_append(a, 9)')} AS ap, {_J.format('array_prepend(a, 9)')} AS pp, {_J.format('array_concat(a, b)')} AS cc, array_max(a) AS mx, array_element(a, 2) AS el, array_element(a, -1) AS la, {_J.format('sort_array(array_distinct(a))')} AS di, {_J.format('sort_array(array_union(a, b))')} AS un, {_J.format('sort_array(array_intersect(a, b))')} AS it, {_J.format('sort_array(array_except(a, b))')} AS ex, {_J.format('flatten(array(a, b))')} AS fl FROM {_ARR}",
    f"SELECT id, list_contains(a, 3) AS c, list_has_any(a, b) AS ha, list_has_all(a, [3]) AS hl, len(a) AS n, {_J.format('list_append(a, 9)')} AS ap, {_J.format('list_prepend(9, a)')} AS pp, {_J.format('list_concat(a, b)')} AS cc, list_max(a) AS mx, a[2] AS el, a[-1] AS la, {_J.format('list_sort(list_distinct(a))')} AS di, {_J.format('list_sort(list_distinct(list_concat(a, b)))')} AS un, {_J.format('list_sort(list_distinct(list_intersect(a, b)))')} AS it, {_J.format('list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))')} AS ex, {_J.format('flatten([a, b])')} AS fl FROM {_LIST}",
)


@query(
    "h7_arrays_composed",
    f"""SELECT id, {_J.format('a[2:3]')} AS sl, {_J.format('a[2:]')} AS pf, {_J.format('a[:3]')} AS pb, {_J.format('list_transform(a, lambda x: CASE WHEN x = 3 THEN 77 ELSE x END)')} AS ra,
        {_J.format('list_filter(a, lambda x: x <> 3)')} AS rm, nullif(list_position(a, 3), 0) AS ps, len(a) = 0 AS em, {_J.format('range(1, 4)')} AS rg, {_J.format('generate_series(1, 4)')} AS gs FROM {_LIST}""",
)
def _(ctx):
    from larkspur.functions import call

    a = F.col("a")
    show = lambda c: F.array_join(c.cast("array<string>"), ",")
    df = ctx.sql(f"SELECT * FROM {_ARR}").df
    return df.select(
        "id", show(call("array_slice", a, 2, 3)).alias("sl"), show(call("array_pop_front", a)).alias("pf"), show(call("array_pop_back", a)).alias("pb"), show(call("array_replace_all", a, F.lit(3), F.lit(77))).alias("ra"),
        show(call("array_remove_all", a, F.lit(3))).alias("rm"), call("array_position", a, F.lit(3)).cast("int").alias("ps"), call("empty", a).alias("em"), show(call("range", 1, 4)).alias("rg"), show(call("generate_series", 1, 4)).alias("gs"),
    )


@query("h7_array_distance", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS d FROM embeddings")
def _(ctx):
    from larkspur.functions import call

    v = F.col("embedding").cast("array<double>")
    return ctx.table("embeddings").df.select("vec_id", F.round(call("array_distance", v, F.transform(v, lambda x: F.lit(0.0))), 6).alias("d"))


sql_query(
    "h8_structs_maps", "SELECT n_nationkey, element_at(m, n_name) AS v, array_to_string(map_keys(m), ',') AS k, array_to_string(map_values(m), ',') AS vs, cardinality(m) AS n FROM (SELECT *, map(n_name, n_regionkey) AS m FROM nation)",
    "SELECT n_nationkey, n_regionkey AS v, n_name AS k, CAST(n_regionkey AS VARCHAR) AS vs, CAST(1 AS INT) AS n FROM nation",
)
sql_query("h9_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql_query("h10_meta", "SELECT n_nationkey, arrow_cast(n_nationkey, 'Int64') AS c, arrow_typeof(n_name) AS t FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS c, 'string' AS t FROM nation")
sql_query("h11_unnest", "SELECT n_nationkey, unnest(array(n_nationkey, n_regionkey)) AS v FROM nation", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS v FROM nation")
sql_query("h12_table_functions", "SELECT id * 2 AS x FROM range(5, 20)", "SELECT range * 2 AS x FROM range(5, 20)")


sql_query("h7_concat_arrays", "SELECT n_nationkey, array_to_string(concat(array(n_name), array(concat('r', n_regionkey), 'x')), ',') AS t FROM nation", "SELECT n_nationkey, array_to_string(list_concat([n_name], [concat('r', n_regionkey), 'x']), ',') AS t FROM nation")
