"""Inherited functions by name, as Spark columns; what Spark names or defines otherwise is composed here.

``FUNCTIONS`` maps a name to a function of columns. ``call`` looks there
first and then among Spark's own functions of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import natives

Fn = Callable[..., Column]


def _literal(c: Column | str | int) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def gcd(a: Column, b: Column) -> Column:
    """By Euclid; at most 93 steps are needed for 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s.y == 0, s.x).otherwise(s.y).alias("x"), F.when(s.y == 0, F.lit(0).cast("long")).otherwise(s.x % F.when(s.y == 0, F.lit(1)).otherwise(s.y)).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step).getField("x")


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) / g * F.abs(b.cast("long"))).cast("long")


def trunc(x: Column, places: Column | int = 0) -> Column:
    """Towards zero, at a number of decimal places."""
    unit = F.pow(F.lit(10.0), _literal(places))
    return F.signum(x) * F.floor(F.abs(x) * unit) / unit


def date_bin(length: int | str, ts: Column, origin: int | str = 0) -> Column:
    """The start of the bin that holds ts, without time zone; null stays null.

    ``length`` is in seconds, or an interval such as ``15 minutes`` or ``1 month``;
    ``origin`` in seconds since 1970, or a time without zone as text.
    """
    from larkspur.sqlshim import interval_parts

    months, micros = (0, length * 1_000_000) if isinstance(length, int) else interval_parts(length)
    if months and micros or months <= 0 and micros <= 0:
        raise ValueError("bins are of whole months or of a fixed length")
    ts = ts.cast("timestamp_ntz")
    zero = F.expr("timestamp_ntz'1970-01-01'")
    begin = zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(origin)) if isinstance(origin, int) else F.lit(origin).cast("timestamp_ntz")
    if months:
        count = (F.year(ts) - F.year(begin)) * 12 + F.month(ts) - F.month(begin)
        count = count - F.pmod(count, F.lit(months))
        start = begin + F.make_ym_interval(F.lit(0), count)
        return F.when(start > ts, begin + F.make_ym_interval(F.lit(0), count - months)).otherwise(start)
    epoch = lambda t: (F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    past = F.pmod(epoch(ts) - epoch(begin), F.lit(micros))
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), past.cast("decimal(18, 0)") / 1_000_000)


def concat(*args: Column) -> Column:
    """Nulls are passed over."""
    return F.concat_ws("", *args)


#: Strftime directives and Java's date patterns.
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "I": "hh", "p": "a", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "%"}


def java_pattern(fmt: str) -> str:
    """A strftime pattern as a Java pattern."""
    out, i = [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in _STRFTIME:
                raise ValueError(f"no such directive: %{fmt[i + 1]}")
            out.append(_STRFTIME[fmt[i + 1]])
            i += 1
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
        i += 1
    return "".join(out)


def array_slice(a: Column, first: Column | int, last: Column | int) -> Column:
    """From position first to last, both counted from 1 and included."""
    first, last = _literal(first), _literal(last)
    return F.slice(a, first, F.greatest(last - first + 1, F.lit(0)))


def _position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0))


def _without_at(a: Column, at: Column) -> Column:
    """The array without the element at a position (none if null)."""
    return F.when(at.isNull(), a).otherwise(F.filter(a, lambda _, i: i != at - 1))


def array_remove(a: Column, x: Column) -> Column:
    """Without the first element equal to x."""
    return _without_at(a, _position(a, x))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    """The first old becomes new."""
    at = _position(a, old)
    return F.when(at.isNull(), a).otherwise(F.transform(a, lambda e, i: F.when(i == at - 1, new).otherwise(e)))


def array_sort(a: Column, descending: bool = False) -> Column:
    """Nulls come first, in either direction."""
    some = F.sort_array(F.array_compact(a), not descending)
    return F.concat(F.filter(a, lambda e: e.isNull()), some)


def digest(x: Column, algorithm: str) -> Column:
    """A hash sum as bytes."""
    if algorithm == "md5":
        return F.unhex(F.md5(x))
    if algorithm.startswith("sha"):
        return F.unhex(F.sha2(x, int(algorithm[3:])))
    raise ValueError(f"no such algorithm: {algorithm}")


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    """The first match's groups (the whole match, if it has none) as an array; null without a match."""
    import re

    pattern = (f"(?{flags})" if flags else "") + pattern
    groups = re.compile(pattern).groups
    found = F.array(*(F.regexp_extract(s, pattern, i) for i in (range(1, groups + 1) if groups else [0])))
    return F.when(s.rlike(pattern), found)


def similar_to(s: Column, pattern: str) -> Column:
    """SIMILAR TO: the whole string has to match the regular expression, with % and _ as wildcards."""
    return s.rlike(similar_pattern(pattern))


def similar_pattern(pattern: str) -> str:
    out = "".join({"%": ".*", "_": "."}.get(c, c) for c in pattern)
    return f"^(?:{out})$"


FUNCTIONS: dict[str, Fn] = {
    "greatest": natives.greatest, "least": natives.least, "hash_int": natives.hash_int,
    "gcd": gcd, "lcm": lcm, "trunc": trunc, "iszero": lambda x: x == 0, "random": F.rand, "pow": F.pow, "log": lambda *a: F.log10(a[0]) if len(a) == 1 else F.log(a[1]) / F.log(a[0]),
    "starts_with": F.startswith, "ends_with": F.endswith, "strpos": F.instr, "to_hex": lambda n: F.lower(F.hex(n)), "concat": concat, "char_length": lambda s: F.char_length(s).cast("long"),
    "encode": lambda x, how: F.lower(F.hex(x)) if how == "hex" else F.base64(x), "decode": lambda x, how: F.unhex(x) if how == "hex" else F.unbase64(x),
    "sha224": lambda x: F.sha2(x, 224), "sha256": lambda x: F.sha2(x, 256), "sha384": lambda x: F.sha2(x, 384), "sha512": lambda x: F.sha2(x, 512), "digest": digest,
    "regexp_match": regexp_match, "from_unixtime": lambda n: F.timestamp_seconds(n).cast("timestamp_ntz"), "to_char": lambda ts, fmt: F.date_format(ts, java_pattern(fmt)),
    "to_timestamp_seconds": lambda n: F.timestamp_seconds(n).cast("timestamp_ntz"), "to_timestamp_millis": lambda n: F.timestamp_millis(n).cast("timestamp_ntz"),
    "to_timestamp_micros": lambda n: F.timestamp_micros(n).cast("timestamp_ntz"), "to_timestamp_nanos": lambda n: F.timestamp_micros(F.floor(n / 1000)).cast("timestamp_ntz"),
    "to_unixtime": lambda ts: F.unix_timestamp(ts.cast("timestamp")), "to_local_time": lambda ts: ts.cast("timestamp_ntz"), "date_bin": date_bin,
    "dow": lambda ts: F.dayofweek(ts) - 1, "make_array": F.array, "array_concat": F.concat, "array_element": lambda a, i: F.try_element_at(a, _literal(i)),
    "array_length": lambda a: F.size(a).cast("long"), "array_slice": array_slice, "array_has": F.array_contains, "array_has_all": lambda a, b: F.size(F.array_except(b, a)) == 0,
    "array_has_any": F.arrays_overlap, "array_remove_all": F.array_remove, "array_remove": array_remove, "array_remove_n": lambda a, x, n: F.filter(a, lambda e, i: ~((e == x) & (F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x)) <= _literal(n)))),
    "array_replace": array_replace, "array_replace_all": lambda a, old, new: F.transform(a, lambda e: F.when(e == old, new).otherwise(e)),
    "array_positions": lambda a, x: F.array_compact(F.transform(a, lambda e, i: F.when(e == x, i.cast("long") + 1))), "array_position": _position,
    "array_resize": lambda a, n, fill: F.transform(F.sequence(F.lit(1), _literal(n)), lambda i: F.when(i <= F.size(a), F.get(a, i - 1)).otherwise(fill)),
    "array_pop_front": lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), "array_pop_back": lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
    "array_to_string": F.array_join, "string_to_array": lambda s, d: F.split(s, "\\Q" + d + "\\E"), "array_sort": array_sort, "empty": lambda a: F.size(a) == 0,
    "array_any_value": lambda a: F.get(F.array_compact(a), F.lit(0)), "array_distance": lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)),
    "range": lambda a, b, step=1: F.when(_literal(b) > _literal(a), F.sequence(_literal(a), _literal(b) - 1, _literal(step))).otherwise(F.array().cast("array<bigint>")),
    "generate_series": lambda a, b, step=1: F.sequence(_literal(a), _literal(b), _literal(step)), "map_extract": lambda m, k: F.array(F.try_element_at(m, k)), "row": F.struct,
    "arrow_typeof": F.typeof, "arrow_cast": lambda x, kind: x.cast(kind), "covar": F.covar_samp, "var": F.var_samp, "var_sample": F.var_samp, "mean": F.avg, "stddev": F.stddev_samp,
    "string_agg": F.listagg, "approx_distinct": F.approx_count_distinct, "approx_median": lambda x: F.percentile_approx(x, 0.5), "approx_percentile_cont": F.percentile_approx,
    "approx_percentile_cont_with_weight": lambda x, w, p: F.percentile(x, p, w), "nth_value_agg": lambda x, n: F.try_element_at(F.collect_list(x), F.lit(n)),
}


def call(name: str, *args: object) -> Column:
    """The function of that name on columns (and, where a function takes them, plain parameters)."""
    fn = FUNCTIONS.get(name) or getattr(F, name, None)
    if fn is None:
        return F.call_function(name, *(_literal(a) for a in args))
    return fn(*args)


#: SQL bodies of functions that Spark lacks, registered in a session as temporary functions.
SQL_FUNCTIONS = {
    "strpos": "(s STRING, t STRING) RETURNS INT RETURN instr(s, t)",
    "to_hex": "(n BIGINT) RETURNS STRING RETURN lower(hex(n))",
    "starts_with": "(s STRING, t STRING) RETURNS BOOLEAN RETURN startswith(s, t)",
    "ends_with": "(s STRING, t STRING) RETURNS BOOLEAN RETURN endswith(s, t)",
    "iszero": "(x DOUBLE) RETURNS BOOLEAN RETURN x = 0",
    "gcd": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> named_struct('x', if(s.y = 0, s.x, s.y), 'y', if(s.y = 0, 0L, s.x % if(s.y = 0, 1L, s.y)))).x",
    "lcm": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN if(a = 0 OR b = 0, 0L, abs(a) div aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> named_struct('x', if(s.y = 0, s.x, s.y), 'y', if(s.y = 0, 0L, s.x % if(s.y = 0, 1L, s.y)))).x * abs(b))",
    "array_length": "(a ARRAY<STRING>) RETURNS BIGINT RETURN size(a)",
    "sha224": "(x STRING) RETURNS STRING RETURN sha2(x, 224)",
    "sha256": "(x STRING) RETURNS STRING RETURN sha2(x, 256)",
    "sha384": "(x STRING) RETURNS STRING RETURN sha2(x, 384)",
    "sha512": "(x STRING) RETURNS STRING RETURN sha2(x, 512)",
    "to_timestamp_seconds": "(n BIGINT) RETURNS TIMESTAMP_NTZ RETURN cast(timestamp_seconds(n) AS timestamp_ntz)",
    "to_unixtime": "(ts TIMESTAMP) RETURNS BIGINT RETURN unix_timestamp(ts)",
}
