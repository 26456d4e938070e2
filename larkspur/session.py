"""Sessions: configuration, catalog, registration of sources, and SQL."""

from __future__ import annotations

import re
import uuid
from typing import Any

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.expr import Expr
from larkspur.frame import DataFrame
from larkspur.functions import SQL_FUNCTIONS
from larkspur.functions.natives import hash_int_udf
from larkspur.plans import OptimizationRule, optimize_plan, parse_sql
from larkspur.runtime import ship
from larkspur.sources import files
from larkspur.sources.python_sources import read_python
from larkspur.sqlshim import CALLS, analysed, tokens, unquoted
from larkspur.types import arrow_schema
from larkspur.userfunctions import AggregateUDF, ScalarUDF, WindowUDF

CATALOG, SCHEMA = "larkspur", "public"
#: This engine's setting -> Spark's.
_CONF = {
    "execution.batch_size": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "execution.target_partitions": "spark.sql.shuffle.partitions",
    "execution.time_zone": "spark.sql.session.timeZone",
    "execution.parquet.pushdown_filters": "spark.sql.parquet.filterPushdown",
    "optimizer.repartition_aggregations": "spark.sql.adaptive.coalescePartitions.enabled",
    "optimizer.repartition_joins": "spark.sql.adaptive.skewJoin.enabled",
    "optimizer.repartition_file_min_size": "spark.sql.files.maxPartitionBytes",
    "optimizer.prefer_hash_join": "spark.sql.join.preferSortMergeJoin",
}


class SessionConfig:
    """Settings, by this engine's names; those with a Spark counterpart are put in force, the others are kept."""

    def __init__(self, config_options: dict[str, str] | None = None):
        self.options: dict[str, str] = {k: str(v) for k, v in (config_options or {}).items()}
        self.information_schema = False
        self.create_default = True
        self.default_catalog, self.default_schema = CATALOG, SCHEMA

    def set(self, key: str, value: str) -> "SessionConfig":
        self.options[key] = str(value)
        return self

    def with_batch_size(self, n: int) -> "SessionConfig":
        return self.set("execution.batch_size", n)

    def with_target_partitions(self, n: int) -> "SessionConfig":
        return self.set("execution.target_partitions", n)

    def with_repartition_aggregations(self, on: bool) -> "SessionConfig":
        return self.set("optimizer.repartition_aggregations", str(on).lower())

    def with_repartition_joins(self, on: bool) -> "SessionConfig":
        return self.set("optimizer.repartition_joins", str(on).lower())

    def with_repartition_windows(self, on: bool) -> "SessionConfig":
        return self.set("optimizer.repartition_windows", str(on).lower())

    def with_repartition_sorts(self, on: bool) -> "SessionConfig":
        return self.set("optimizer.repartition_sorts", str(on).lower())

    def with_repartition_file_scans(self, on: bool) -> "SessionConfig":
        return self.set("optimizer.repartition_file_scans", str(on).lower())

    def with_repartition_file_min_size(self, n: int) -> "SessionConfig":
        return self.set("optimizer.repartition_file_min_size", n)

    def with_parquet_pruning(self, on: bool) -> "SessionConfig":
        return self.set("execution.parquet.pushdown_filters", str(on).lower())

    def with_information_schema(self, on: bool) -> "SessionConfig":
        self.information_schema = on
        return self

    def with_create_default_catalog_and_schema(self, on: bool) -> "SessionConfig":
        self.create_default = on
        return self

    def with_default_catalog_and_schema(self, catalog: str, schema: str) -> "SessionConfig":
        self.default_catalog, self.default_schema = catalog, schema
        return self

    def spark_options(self) -> dict[str, str]:
        out = {_CONF.get(k, k): v for k, v in self.options.items() if k in _CONF or k.startswith("spark.")}
        if "spark.sql.join.preferSortMergeJoin" in out:
            out["spark.sql.join.preferSortMergeJoin"] = str(out["spark.sql.join.preferSortMergeJoin"].lower() != "true").lower()
        return out


class SessionState:
    """A configuration and optimizer rules."""

    def __init__(self, config: SessionConfig | None = None):
        self.config = config or SessionConfig().with_information_schema(True)
        self.rules: list[OptimizationRule] = []

    def add_optimizer_rule(self, rule: OptimizationRule) -> "SessionState":
        out = SessionState(self.config)
        out.rules = [*self.rules, rule]
        return out


class Table:
    """A named relation of a catalog."""

    def __init__(self, context: "SessionContext", name: str):
        self._context, self.name = context, name

    @property
    def schema(self) -> pa.Schema:
        return arrow_schema(self._context.spark.table(self.name).schema)

    @property
    def kind(self) -> str:
        kind = self._context.spark.catalog.getTable(self.name).tableType
        return {"TEMPORARY": "temporary", "VIEW": "view"}.get(kind, "physical")

    def __repr__(self) -> str:
        return f"Table({self.name}, {self.kind})"


class Database:
    def __init__(self, context: "SessionContext"):
        self._context = context

    def names(self) -> set[str]:
        return self._context.tables()

    def table(self, name: str) -> Table:
        if not self._context.table_exist(name):
            raise KeyError(f"no such table: {name}")
        return Table(self._context, name)


class Catalog:
    def __init__(self, context: "SessionContext"):
        self._context = context

    def names(self) -> list[str]:
        return [self._context.config.default_schema, *(d.name for d in self._context.spark.catalog.listDatabases() if d.name != "default")]

    def database(self, name: str = SCHEMA) -> Database:
        if name not in self.names():
            raise KeyError(f"no such database: {name}")
        return Database(self._context)


class SessionContext:
    """The entry point: register tables, run SQL, get frames.

    Without a ``spark`` the context has a Spark session of its own, beside the
    active one, so its views and settings stay apart.
    """

    def __init__(self, session_state: SessionState | None = None, config: SessionConfig | None = None, spark: SparkSession | None = None):
        self.state = session_state or SessionState(config)
        self.config = self.state.config
        self.spark = spark or SparkSession.builder.getOrCreate().newSession()
        self.id = str(uuid.uuid4())
        self._prepared: dict[str, str] = {}
        self._window_udfs: dict[str, WindowUDF] = {}
        for key, value in self.config.spark_options().items():
            self.spark.conf.set(key, value)
        ship(self.spark)
        self.spark.udf.register("hash_int", hash_int_udf())
        for name, body in SQL_FUNCTIONS.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    # sql
    def sql(self, query: str, args: dict[str, Any] | list | None = None) -> DataFrame:
        """Run one statement: queries, DDL, INSERT, COPY, PREPARE and EXECUTE, SHOW, EXPLAIN."""
        query = query.strip().rstrip(";")
        special = self._statement(query)
        if special is not None:
            return special
        if self.config.information_schema and "information_schema" in query.lower():
            self._information_schema()
        if isinstance(args, list):
            args = {f"p{i + 1}": v for i, v in enumerate(args)}
        elif args:
            args = {k if k.startswith("p") and k[1:].isdigit() else f"p{k.lstrip('$')}": v for k, v in args.items()}
        window = self._window_call(query)
        df = window if window is not None else analysed(self.spark, query, args)
        return self._ruled(df)

    def _ruled(self, df) -> DataFrame:
        for rule in self.state.rules:
            df = rule.try_optimize(df)
        return DataFrame(df)

    def _empty(self) -> DataFrame:
        return DataFrame(self.spark.createDataFrame([], T.StructType([])))

    def _statement(self, query: str) -> DataFrame | None:
        head = re.match(r"\s*(\w+)", query)
        word = head[1].lower() if head else ""
        if word == "copy":
            m = re.fullmatch(r"copy\s+(\(.*\)|[\w.]+)\s+to\s+('(?:[^']|'')*')(?:\s+stored\s+as\s+(\w+))?(?:\s+options\s*\((.*)\))?", query, re.I | re.S)
            if not m:
                raise ValueError("COPY (query) TO 'path' [STORED AS format] [OPTIONS (…)]")
            source, target = m[1], unquoted(m[2])
            df = self.sql(source[1:-1]) if source.startswith("(") else self.table(source)
            kind = (m[3] or target.rpartition(".")[2]).lower()
            counted = Observation()
            writer = df.df.observe(counted, F.count(F.lit(1)).alias("count")).write.options(**_pairs(m[4]))
            getattr(writer.option("header", True) if kind == "csv" else writer, kind)(target)
            return DataFrame(self.spark.createDataFrame([(counted.get["count"],)], "count bigint"))
        if re.match(r"\s*create\s+external\s+table", query, re.I):
            m = re.fullmatch(
                r"\s*create\s+external\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*(\(.*?\))?\s*stored\s+as\s+(\w+)(\s+with\s+header\s+row)?(?:\s+partitioned\s+by\s*\(([^)]*)\))?\s*location\s+('(?:[^']|'')*')(?:\s+options\s*\((.*)\))?", query, re.I | re.S
            )
            if not m:
                raise ValueError("CREATE EXTERNAL TABLE name STORED AS format LOCATION 'path'")
            reader = self.spark.read.options(**_pairs(m[7]))
            kind = m[3].lower()
            if kind == "csv":
                reader = reader.option("header", bool(m[4]) or "true" in _pairs(m[7]).get("has_header", "true").lower()).option("inferSchema", not m[2])
            if m[2]:
                reader = reader.schema(m[2][1:-1])
            reader.format({"ndjson": "json", "jsonl": "json"}.get(kind, kind)).load(unquoted(m[6])).createOrReplaceTempView(m[1])
            return self._empty()
        if word == "prepare":
            m = re.fullmatch(r"prepare\s+(\w+)\s*(?:\([^)]*\))?\s+as\s+(.*)", query, re.I | re.S)
            if not m:
                raise ValueError("PREPARE name AS query")
            self._prepared[m[1].lower()] = m[2]
            return self._empty()
        if word == "execute" and not re.match(r"execute\s+immediate", query, re.I):
            m = re.fullmatch(r"execute\s+(\w+)\s*(?:\((.*)\))?", query, re.I | re.S)
            if not m or m[1].lower() not in self._prepared:
                raise ValueError(f"no prepared statement: {query}")
            values = self.spark.sql(f"SELECT {m[2]}").first() if m[2] else ()
            return self.sql(self._prepared[m[1].lower()], list(values))
        if word == "deallocate":
            self._prepared.pop(query.split()[-1].lower(), None)
            return self._empty()
        return None

    def _window_call(self, query: str):
        """A SELECT of one block with calls of registered window functions OVER (…): they are appended to its source first."""
        if not self._window_udfs or not any(t[0] == "word" and t[1].lower() in self._window_udfs for t in tokens(query)):
            return None
        m = re.fullmatch(r"\s*select\s+(.*?)\s+from\s+(.*?)(\s+(?:order\s+by|limit)\s+.*)?", query, re.I | re.S)
        if not m:
            raise ValueError("window functions of one's own stand in SELECT … FROM … of one block")
        items, source, tail = m[1], m[2], m[3] or ""
        df = analysed(self.spark, f"SELECT * FROM {source}")
        names = "|".join(map(re.escape, self._window_udfs))
        part = r"(?:\s*partition\s+by\s+(?P<parts>.*?))?(?:\s*order\s+by\s+(?P<orders>.*?))?(?:\s*(?P<frame>(?:rows|range|groups)\s+between\s+.*?))?\s*"
        call = re.compile(rf"\b(?P<fn>{names})\s*\((?P<args>[^()]*)\)\s+over\s*\({part}\)", re.I | re.S)
        count = 0
        while found := call.search(items):
            alias = f"__w{count}"
            fn = self._window_udfs[found["fn"].lower()]
            exprs = lambda text: [_sql_expr(x.strip()) for x in (text or "").split(",") if x.strip()]
            orders = [_sort_expr(x.strip()) for x in (found["orders"] or "").split(",") if x.strip()]
            df = fn.append(df, fn(*exprs(found["args"])).over(exprs(found["parts"]), orders, _frame(found["frame"])), alias)
            items = items[: found.start()] + alias + items[found.end() :]
            count += 1
        view = f"__window_{uuid.uuid4().hex}"
        visible = [c for c in df.columns if not c.startswith("__w")]
        items = re.sub(r"(^|,)\s*\*", lambda s: f"{s[1]} {', '.join(f'`{c}`' for c in visible)}", items)
        df.createOrReplaceTempView(view)
        return analysed(self.spark, f"SELECT {items} FROM {view} {tail}")

    def _information_schema(self) -> None:
        tables, columns = [], []
        for t in self.spark.catalog.listTables():
            if t.name.startswith(("information_schema_", "__window_")):
                continue
            kind = {"TEMPORARY": "VIEW", "VIEW": "VIEW"}.get(t.tableType, "BASE TABLE")
            tables.append((self.config.default_catalog, self.config.default_schema, t.name, kind))
            for i, f in enumerate(self.spark.table(t.name).schema):
                columns.append((self.config.default_catalog, self.config.default_schema, t.name, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO"))
        self.spark.createDataFrame(tables, "table_catalog string, table_schema string, table_name string, table_type string").createOrReplaceTempView("information_schema_tables")
        self.spark.createDataFrame(columns, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string").createOrReplaceTempView("information_schema_columns")
        self.spark.createDataFrame([(self.config.default_catalog, self.config.default_schema)], "catalog_name string, schema_name string").createOrReplaceTempView("information_schema_schemata")
        self.spark.createDataFrame(sorted(self.config.options.items()), "name string, value string").createOrReplaceTempView("information_schema_df_settings")

    def parse(self, sql: str, provider) -> Any:
        return parse_sql(sql, provider, spark=self.spark)

    def optimize(self, plan, context=None) -> Any:
        return optimize_plan(plan, context, rules=self.state.rules, spark=self.spark)

    # catalog
    def tables(self) -> set[str]:
        return {t.name for t in self.spark.catalog.listTables() if not t.name.startswith(("information_schema_", "__window_"))}

    def table(self, name: str) -> DataFrame:
        return self._ruled(self.spark.table(_plain_name(name)))

    def table_exist(self, name: str) -> bool:
        return self.spark.catalog.tableExists(_plain_name(name))

    def deregister_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(_plain_name(name))

    def empty_table(self) -> DataFrame:
        return self._empty()

    def catalog(self, name: str = CATALOG) -> Catalog:
        if name != self.config.default_catalog:
            raise KeyError(f"no such catalog: {name}")
        return Catalog(self)

    def register_table(self, name: str, table: Table) -> None:
        self.spark.table(table.name).createOrReplaceTempView(name)

    def register_dataframe(self, name: str, df: DataFrame) -> None:
        df.df.createOrReplaceTempView(name)

    # sources
    def register_parquet(self, name: str, path: str, table_partition_cols: list[tuple[str, str]] | None = None, parquet_pruning: bool = True, file_extension: str = ".parquet", skip_metadata: bool = True, schema: pa.Schema | None = None, storage_options: dict[str, str] | None = None) -> None:
        files.read_parquet(self.spark, str(path), partition_cols=table_partition_cols, pruning=parquet_pruning, extension=file_extension, schema=schema, storage_options=storage_options).createOrReplaceTempView(name)

    def register_csv(self, name: str, path: str, schema: pa.Schema | None = None, has_header: bool = True, delimiter: str = ",", schema_infer_max_records: int = 1000, file_extension: str = ".csv", file_compression_type: str | None = None, storage_options: dict[str, str] | None = None, newlines_in_values: bool | None = None) -> None:
        files.read_csv(
            self.spark, str(path), schema=schema, has_header=has_header, delimiter=delimiter, infer_rows=schema_infer_max_records, extension=file_extension, compression=file_compression_type, storage_options=storage_options, newlines_in_values=newlines_in_values,
        ).createOrReplaceTempView(name)

    def register_json(self, name: str, path: str, schema: pa.Schema | None = None, storage_options: dict[str, str] | None = None) -> None:
        files.read_json(self.spark, str(path), schema=schema, storage_options=storage_options).createOrReplaceTempView(name)

    def register_record_batches(self, name: str, partitions: list[list[pa.RecordBatch]]) -> None:
        batches = [b for p in partitions for b in p]
        if not batches:
            raise ValueError("at least one record batch is needed for its schema")
        df = files.from_arrow(self.spark, pa.Table.from_batches(batches))
        (df.repartition(len(partitions)) if len(partitions) > 1 else df).createOrReplaceTempView(name)

    def register_record_batch_reader(self, name: str, reader: pa.RecordBatchReader, sort_order: list | None = None) -> None:
        """The reader is read once, now; later scans see all of it. A declared order is put in force within partitions."""
        df = files.from_arrow(self.spark, reader.read_all())
        keys = []
        for key in sort_order or []:
            expr = getattr(key, "over", key)
            if not isinstance(expr, Expr) or not hasattr(expr, "text"):
                raise ValueError("sort_order takes column expressions")
            if expr.text not in df.columns:
                break
            keys.append(key.to_column())
        (df.sortWithinPartitions(*keys) if keys else df).createOrReplaceTempView(name)

    def register_dataset(self, name: str, dataset: pads.Dataset) -> None:
        """A dataset of plain Parquet files is read by Spark itself, one in memory is handed over, any other has a Python source."""
        if not isinstance(dataset, pads.Dataset):
            raise ValueError(f"not a pyarrow dataset: {dataset!r}")
        kind = getattr(getattr(dataset, "format", None), "default_extname", None)
        if isinstance(dataset, pads.FileSystemDataset) and kind == "parquet" and dataset.files and set(dataset.schema.names) == set(self.spark.read.parquet(dataset.files[0]).columns):
            df = self.spark.read.parquet(*dataset.files).select(*dataset.schema.names)
        elif isinstance(dataset, pads.InMemoryDataset):
            df = files.from_arrow(self.spark, dataset.to_table())
        else:
            df = read_python(self.spark, "dataset", dataset, dataset.schema)
        df.createOrReplaceTempView(name)

    def register_table_provider(self, name: str, provider: Any) -> None:
        read_python(self.spark, "provider", provider, provider.schema()).createOrReplaceTempView(name)

    def register_ibis_table(self, name: str, table: Any) -> None:
        """A deferred table with ``schema()``, ``filter(*predicates)`` and ``to_pyarrow_batches()``."""
        schema = table.schema()
        read_python(self.spark, "foreign", table, schema if isinstance(schema, pa.Schema) else schema.to_pyarrow()).createOrReplaceTempView(name)

    # functions
    def register_udf(self, udf: ScalarUDF) -> None:
        udf.register(self.spark)
        CALLS.pop(udf.name, None)

    def register_udaf(self, udaf: AggregateUDF) -> None:
        udaf.register(self.spark)

    def register_udwf(self, udwf: WindowUDF) -> None:
        self._window_udfs[udwf.name.lower()] = udwf

    # identity
    def session_id(self) -> str:
        return self.id

    def __repr__(self) -> str:
        own = {**self.config.options, "catalog.default_catalog": self.config.default_catalog, "catalog.default_schema": self.config.default_schema}
        return f"SessionContext: id={self.id}; configs=[{', '.join(f'{k}={v}' for k, v in sorted(own.items()) if v)}]"


def _plain_name(name: str) -> str:
    return name.rpartition(".")[2] if name.startswith((f"{CATALOG}.", f"{SCHEMA}.")) else name


def _pairs(text: str | None) -> dict[str, str]:
    """OPTIONS ('k' 'v', …) as a dictionary."""
    return {k.strip("'").rpartition(".")[2]: v for k, v in re.findall(r"('[^']*'|[\w.]+)\s+'?([^',]*)'?", text or "")}


def _sql_expr(text: str) -> Expr:
    from larkspur.plans.nodes import SqlExpr

    return SqlExpr(text)


def _sort_expr(text: str) -> Expr:
    from larkspur.expr import SortExpr

    m = re.fullmatch(r"(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?", text, re.I | re.S)
    descending = (m[2] or "").lower() == "desc"
    return SortExpr(_sql_expr(m[1]), not descending, m[3].lower() == "first" if m[3] else descending)


def _frame(text: str | None):
    from larkspur.expr import WindowFrame

    if not text:
        return None
    m = re.fullmatch(r"(rows|range|groups)\s+between\s+(unbounded|current|\d+)\s+\w+\s+and\s+(unbounded|current|\d+)\s+\w+\s*", text.strip(), re.I)
    if not m:
        raise ValueError(f"unexpected frame: {text}")
    end = lambda v: None if v.lower() == "unbounded" else 0 if v.lower() == "current" else int(v)
    return WindowFrame(m[1], end(m[2]), end(m[3]))


__all__ = ["Catalog", "Database", "SessionConfig", "SessionContext", "SessionState", "Table"]
