"""How queries are registered: by name, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession

from larkspur.frame import DataFrame
from larkspur.session import SessionContext

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], SparkDataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def context(spark: SparkSession, sf_dir: str) -> SessionContext:
    """A context on the given session with all tables of a folder registered."""
    held = getattr(spark, "_larkspur_context", None)
    if held is None:
        held = spark._larkspur_context = SessionContext(spark=spark)
    if getattr(held, "folder", None) != sf_dir:
        for name in TABLES:
            held.register_parquet(name, f"{sf_dir.rstrip('/')}/{name}.parquet")
        held.folder = sf_dir
    return held


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a context that gives a frame."""

    def keep(fn: Callable[[SessionContext], DataFrame | SparkDataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> SparkDataFrame:
            out = fn(context(spark, sf_dir))
            return out.df if isinstance(out, DataFrame) else out

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def sql_query(name: str, engine: str, oracle: str | None = None, check: bool = True) -> None:
    """Register a SQL query; the oracle's text is the same unless given."""
    query(name, (oracle or engine) if check else None)(lambda ctx: ctx.sql(engine))
