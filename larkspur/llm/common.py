"""Helpers shared by the operators: stored tables, table paths, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.runtime import shared_folder


_scratch: list[list[DataFrame]] = []


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors: whatever reads it reads files that all
    machines share. It goes with :func:`drop`, at the end of a :func:`scratch`
    block that it was written in, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    where, system = _file(out)
    system.deleteOnExit(where)
    if _scratch:
        _scratch[-1].append(out)
    return out


def _file(df: DataFrame) -> tuple:
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    return where, where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def drop(df: DataFrame | None) -> None:
    """Delete a table that :func:`store` wrote."""
    if getattr(df, "_stored_at", None):
        where, system = _file(df)
        system.delete(where, True)
        system.cancelDeleteOnExit(where)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within the block are dropped at its end, but for those handed to what it gives."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scratch.append(held)
    try:
        yield keep
    finally:
        _scratch.remove(held)
        paths = {df._stored_at for df in kept}
        for df in held:
            if df._stored_at not in paths:
                drop(df)


def prefix_for(names: Iterable[str]) -> str:
    """Underscores that begin none of the names, so that columns so named clash with none."""
    return "_" * (1 + max((len(n) - len(n.lstrip("_")) for n in names), default=0))


def cols(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of the columns of df that can be hashed (maps can't)."""
    fit = [F.col(quoted(f.name)) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*fit) if fit else F.lit(0).cast("long")


#: Most bytes of an Arrow batch that goes to a Python worker, whatever the length of its texts.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df itself; its session sends Python workers batches of at most BATCH_BYTES (or less, as set)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any name: fn sees and gives columns by position."""
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fn(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, numbered.names)

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, numbered)
    return out.toDF(*schema.names)


def arrow_rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function from one on record batches; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return run


def parts(batch: pa.RecordBatch, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text each (whole rows)."""
    from larkspur.llm.textkernel import buffer_of, slices

    _, off = buffer_of(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(np.zeros(0, np.uint8), off, size):
        yield batch.slice(i, j - i)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps until every node hangs on one
    smallest node alone; edges that are such stars from the start cost no
    round. Each step is an aggregation with map-side minima and a join, no
    group is gathered in one place (join keys carry a hash beside the node, so
    that a node of very many edges comes by an exchange that AQE can split),
    and each round's edges are stored in the shared folder. Rounds grow with
    the logarithm of the longest path.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        # Large star: every larger neighbour of a node hangs on the node's smallest neighbour.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = now.join(least, _same(now.v, least.w)).select(F.col("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(small, _same(F.col("u"), F.col("w")))
        after = store(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        )
        drop(now)
        now = after
    else:
        raise RuntimeError("components did not converge")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._stored_at = now._stored_at
    return out


def _same(a: Column, b: Column) -> Column:
    """a = b, by two keys: sides dealt out by one of them alone are dealt out anew."""
    return (F.xxhash64(a) == F.xxhash64(b)) & (a == b)


def _are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, are stars: each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("n")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("ends")).where("n > 1 or n = 1 and ends > 1").isEmpty()
