"""Arrow, SQL and Python type labels, and bringing Arrow data into Spark's types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import types as T

PythonType = Enum("PythonType", "Array Bool Bytes Datetime Float Int List None Object Str")
RexType = Enum("RexType", "Alias Literal Call Reference ScalarSubquery Other")
#: The SQL type labels of the compatibility surface.
SqlType = Enum(
    "SqlType",
    "ANY ARRAY BIGINT BINARY BOOLEAN CHAR COLUMN_LIST CURSOR DATE DECIMAL DISTINCT DOUBLE DYNAMIC_STAR FLOAT GEOMETRY INTEGER INTERVAL INTERVAL_DAY "
    "INTERVAL_DAY_HOUR INTERVAL_DAY_MINUTE INTERVAL_DAY_SECOND INTERVAL_HOUR INTERVAL_HOUR_MINUTE INTERVAL_HOUR_SECOND INTERVAL_MINUTE "
    "INTERVAL_MINUTE_SECOND INTERVAL_MONTH INTERVAL_SECOND INTERVAL_YEAR INTERVAL_YEAR_MONTH MAP MULTISET NULL OTHER REAL ROW SARG SMALLINT STRUCTURED "
    "SYMBOL TIME TIME_WITH_LOCAL_TIME_ZONE TIMESTAMP TIMESTAMP_WITH_LOCAL_TIME_ZONE TINYINT UNKNOWN VARBINARY VARCHAR",
)
_NONE = PythonType["None"]

#: Arrow type (by its id) -> friendly name, Python label, SQL label (None: the label interface rejects it).
_LABELS: dict[int, tuple[str, PythonType | None, SqlType | None]] = {
    pa.lib.Type_NA: ("Null", _NONE, SqlType.NULL),
    pa.lib.Type_BOOL: ("Boolean", PythonType.Bool, SqlType.BOOLEAN),
    pa.lib.Type_INT8: ("Int8", PythonType.Int, SqlType.TINYINT),
    pa.lib.Type_INT16: ("Int16", PythonType.Int, SqlType.SMALLINT),
    pa.lib.Type_INT32: ("Int32", PythonType.Int, SqlType.INTEGER),
    pa.lib.Type_INT64: ("Int64", PythonType.Int, SqlType.BIGINT),
    pa.lib.Type_UINT8: ("UInt8", PythonType.Int, SqlType.TINYINT),
    pa.lib.Type_UINT16: ("UInt16", PythonType.Int, SqlType.SMALLINT),
    pa.lib.Type_UINT32: ("UInt32", PythonType.Int, SqlType.INTEGER),
    pa.lib.Type_UINT64: ("UInt64", PythonType.Int, SqlType.BIGINT),
    pa.lib.Type_HALF_FLOAT: ("Float16", PythonType.Float, SqlType.FLOAT),
    pa.lib.Type_FLOAT: ("Float32", PythonType.Float, SqlType.FLOAT),
    pa.lib.Type_DOUBLE: ("Float64", PythonType.Float, SqlType.FLOAT),
    pa.lib.Type_TIMESTAMP: ("Timestamp", PythonType.Datetime, SqlType.DATE),
    pa.lib.Type_DATE32: ("Date32", PythonType.Datetime, SqlType.DATE),
    pa.lib.Type_DATE64: ("Date64", PythonType.Datetime, SqlType.DATE),
    pa.lib.Type_TIME32: ("Time32", PythonType.Datetime, SqlType.DATE),
    pa.lib.Type_TIME64: ("Time64", PythonType.Datetime, SqlType.DATE),
    pa.lib.Type_DURATION: ("Duration", None, None),
    pa.lib.Type_INTERVAL_MONTH_DAY_NANO: ("Interval", PythonType.Datetime, SqlType.INTERVAL_MONTH),
    pa.lib.Type_BINARY: ("Binary", PythonType.Bytes, SqlType.BINARY),
    pa.lib.Type_FIXED_SIZE_BINARY: ("FixedSizeBinary", None, None),
    pa.lib.Type_LARGE_BINARY: ("LargeBinary", PythonType.Bytes, SqlType.BINARY),
    pa.lib.Type_STRING: ("Utf8", PythonType.Str, SqlType.VARCHAR),
    pa.lib.Type_LARGE_STRING: ("LargeUtf8", PythonType.Str, SqlType.VARCHAR),
    pa.lib.Type_LIST: ("List", None, None),
    pa.lib.Type_FIXED_SIZE_LIST: ("FixedSizeList", None, None),
    pa.lib.Type_LARGE_LIST: ("LargeList", None, None),
    pa.lib.Type_STRUCT: ("Struct", None, None),
    pa.lib.Type_DICTIONARY: ("Dictionary", None, None),
    pa.lib.Type_DECIMAL128: ("Decimal128", PythonType.Float, SqlType.DECIMAL),
    pa.lib.Type_DECIMAL256: ("Decimal256", PythonType.Float, SqlType.DECIMAL),
    pa.lib.Type_MAP: ("Map", None, None),
}
#: SQL label -> Arrow type; a label that isn't here has none.
_SQL_TO_ARROW = {
    SqlType.BIGINT: pa.int64(), SqlType.BINARY: pa.binary(), SqlType.BOOLEAN: pa.bool_(), SqlType.CHAR: pa.uint8(), SqlType.DATE: pa.date64(),
    SqlType.DECIMAL: pa.decimal128(1, 1), SqlType.DOUBLE: pa.decimal256(1, 1), SqlType.FLOAT: pa.decimal128(1, 1), SqlType.INTEGER: pa.int8(),
    SqlType.NULL: pa.null(), SqlType.SMALLINT: pa.int16(), SqlType.TINYINT: pa.int8(), SqlType.VARBINARY: pa.large_binary(), SqlType.VARCHAR: pa.string(),
}
_SQL_PYTHON = {SqlType.CHAR: PythonType.Int, SqlType.DATE: PythonType.Datetime}
#: Parquet's physical types, and pandas-like names.
_PARQUET = {"boolean": pa.bool_(), "int32": pa.int32(), "int64": pa.int64(), "int96": pa.timestamp("ns"), "float": pa.float32(), "double": pa.float64(), "byte_array": pa.string()}
_NAMED = {
    "bool": pa.bool_(), "boolean": pa.bool_(), "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(), "int8": pa.int8(),
    "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "float": pa.float32(), "double": pa.float64(), "float16": pa.float16(),
    "float32": pa.float32(), "float64": pa.float64(), "datetime64": pa.date64(), "object": pa.string(),
}


@dataclass(frozen=True)
class DataType:
    """An Arrow type, with its pandas-like name."""

    data_type: pa.DataType

    @classmethod
    def from_arrow_str(cls, name: str) -> "DataType":
        short = name.split("[", 1)[0].lower()
        if short not in _NAMED:
            raise ValueError(f"Unable to determine Arrow Data Type from Arrow String type: {name!r}")
        return cls(_NAMED[short])

    def to_arrow_str(self) -> str:
        for name, kind in _NAMED.items():
            if kind == self.data_type and name not in ("bool", "float", "double"):
                return name
        raise ValueError(f"Unable to determine Arrow String type from {self.data_type}")


@dataclass
class DataTypeMap:
    arrow_type: DataType
    python_type: PythonType
    sql_type: SqlType

    @classmethod
    def arrow(cls, arrow_type: pa.DataType) -> "DataTypeMap":
        _, python, sql = _LABELS.get(arrow_type.id, (None, None, None))
        if sql is None:
            raise NotImplementedError(str(arrow_type))
        return cls(DataType(arrow_type), python, sql)

    @classmethod
    def sql(cls, sql_type: SqlType) -> "DataTypeMap":
        if sql_type not in _SQL_TO_ARROW:
            raise NotImplementedError(sql_type.name)
        arrow = _SQL_TO_ARROW[sql_type]
        return cls(DataType(arrow), _SQL_PYTHON.get(sql_type) or _LABELS[arrow.id][1], sql_type)

    @classmethod
    def from_parquet_type_str(cls, name: str) -> "DataTypeMap":
        if name.lower() not in _PARQUET:
            raise ValueError(f"Unable to determine Arrow Data Type from Parquet String type: {name!r}")
        return cls.arrow(_PARQUET[name.lower()])

    def friendly_arrow_type_name(self) -> str:
        return _LABELS[self.arrow_type.data_type.id][0]


def to_spark(kind: pa.DataType) -> T.DataType:
    """The Spark type that holds an Arrow type: unsigned integers widen, encodings and fixed lengths go."""
    t = pa.types
    simple = {
        pa.null(): T.NullType(), pa.bool_(): T.BooleanType(), pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(),
        pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0), pa.float16(): T.FloatType(),
        pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.date32(): T.DateType(), pa.date64(): T.DateType(),
    }
    if kind in simple:
        return simple[kind]
    if t.is_string(kind) or t.is_large_string(kind) or t.is_string_view(kind):
        return T.StringType()
    if t.is_binary(kind) or t.is_large_binary(kind) or t.is_fixed_size_binary(kind) or t.is_binary_view(kind):
        return T.BinaryType()
    if t.is_timestamp(kind):
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if t.is_time(kind):
        return T.LongType()
    if t.is_duration(kind):
        return T.DayTimeIntervalType()
    if t.is_decimal(kind) and kind.precision <= 38:
        return T.DecimalType(kind.precision, kind.scale)
    if t.is_dictionary(kind) or t.is_run_end_encoded(kind):
        return to_spark(kind.value_type)
    if t.is_map(kind):
        return T.MapType(to_spark(kind.key_type), to_spark(kind.item_type))
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        return T.ArrayType(to_spark(kind.value_type))
    if t.is_struct(kind):
        return T.StructType([T.StructField(f.name, to_spark(f.type), f.nullable) for f in kind])
    raise NotImplementedError(f"no Spark type holds {kind}")


def spark_schema(schema: pa.Schema) -> T.StructType:
    return T.StructType([T.StructField(f.name, to_spark(f.type), f.nullable) for f in schema])


def _carrier(kind: pa.DataType) -> pa.DataType:
    """The Arrow type that Spark takes in for a kind."""
    t = pa.types
    wide = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.date64(): pa.date32()}
    if kind in wide:
        return wide[kind]
    if t.is_large_string(kind) or t.is_string_view(kind):
        return pa.string()
    if t.is_large_binary(kind) or t.is_fixed_size_binary(kind) or t.is_binary_view(kind):
        return pa.binary()
    if t.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if t.is_duration(kind):
        return pa.duration("us")
    if t.is_dictionary(kind) or t.is_run_end_encoded(kind):
        return _carrier(kind.value_type)
    if t.is_decimal(kind):
        return pa.decimal128(kind.precision, kind.scale)
    if t.is_map(kind):
        return pa.map_(_carrier(kind.key_type), _carrier(kind.item_type))
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        return pa.list_(_carrier(kind.value_type))
    if t.is_struct(kind):
        return pa.struct([pa.field(f.name, _carrier(f.type), f.nullable) for f in kind])
    return kind


def normalise(table: pa.Table) -> pa.Table:
    """The table in types that Spark takes in; times of day become nanoseconds since midnight."""
    columns = []
    for f, c in zip(table.schema, table.columns):
        to_spark(f.type)
        if pa.types.is_time(f.type):
            c = c.cast(pa.time64("ns")).cast(pa.int64())
        elif pa.types.is_run_end_encoded(f.type):
            c = pa.chunked_array([pa.compute.run_end_decode(x) for x in c.chunks]).cast(_carrier(f.type))
        elif _carrier(f.type) != f.type:
            c = c.cast(_carrier(f.type), safe=False)
        columns.append(c)
    return pa.table(dict(zip(table.column_names, columns))) if len(set(table.column_names)) == table.num_columns else pa.Table.from_arrays(columns, names=table.column_names)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
