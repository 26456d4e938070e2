"""The DataFrame: a lazy relation over a Spark DataFrame."""

from __future__ import annotations

import asyncio
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.types import arrow_schema

_JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


class RecordBatch:
    """One batch of a stream."""

    def __init__(self, batch: pa.RecordBatch):
        self._batch = batch

    def to_pyarrow(self) -> pa.RecordBatch:
        return self._batch


class RecordBatchStream:
    """Batches as they come, by ``for`` or ``async for``; errors are raised, not taken for the end."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self._batches = iter(batches)

    def __iter__(self) -> "RecordBatchStream":
        return self

    def __next__(self) -> RecordBatch:
        return RecordBatch(next(self._batches))

    next = __next__

    def __aiter__(self) -> "RecordBatchStream":
        return self

    async def __anext__(self) -> RecordBatch:
        got = await asyncio.get_running_loop().run_in_executor(None, lambda: next(self._batches, None))
        if got is None:
            raise StopAsyncIteration
        return RecordBatch(got)


class ExecutionPlan:
    """Spark's physical plan, to look at."""

    def __init__(self, plan: Any, partitions: int | None = None):
        self._plan, self._partitions = plan, partitions

    @property
    def partition_count(self) -> int:
        return self._partitions if self._partitions is not None else self._plan.outputPartitioning().numPartitions()

    def children(self) -> list["ExecutionPlan"]:
        seq = self._plan.children()
        return [ExecutionPlan(seq.apply(i)) for i in range(seq.size())]

    def display(self) -> str:
        return self._plan.nodeName()

    def display_indent(self) -> str:
        return self._plan.treeString()

    def __repr__(self) -> str:
        return self.display_indent()


def _null_safe(left: SparkDataFrame, right: SparkDataFrame) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"l.{_quoted(a)}").eqNullSafe(F.col(f"r.{_quoted(b)}")) for a, b in zip(left.columns, right.columns)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unpacked(data: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(data))


class DataFrame:
    def __init__(self, df: SparkDataFrame):
        self.df = df

    # relational
    def __getitem__(self, key: str | tuple | list) -> "DataFrame":
        if isinstance(key, str):
            return self.select_columns(key)
        if isinstance(key, tuple | list) and all(isinstance(k, str) for k in key):
            return self.select_columns(*key)
        raise TypeError("a frame is indexed by a column name, or by several")

    def select_columns(self, *names: str) -> "DataFrame":
        return DataFrame(self.df.select(*(F.col(_quoted(n)) for n in names)))

    def with_column_renamed(self, old: str, new: str) -> "DataFrame":
        return DataFrame(self.df.withColumnRenamed(old, new))

    def limit(self, count: int, offset: int = 0) -> "DataFrame":
        return DataFrame((self.df.offset(offset) if offset else self.df).limit(count))

    def distinct(self) -> "DataFrame":
        return DataFrame(self.df.distinct())

    def repartition(self, num: int) -> "DataFrame":
        return DataFrame(self.df.repartition(num))

    def join(self, right: "DataFrame", join_keys: tuple[list[str], list[str]], how: str) -> "DataFrame":
        """An equi-join; both sides' key columns stay."""
        if how not in _JOINS:
            raise ValueError(f"no such join type: {how}")
        left_keys, right_keys = join_keys
        if len(left_keys) != len(right_keys) or not left_keys:
            raise ValueError("join needs as many left keys as right keys")
        on = reduce(lambda a, b: a & b, (F.col(f"l.{_quoted(a)}") == F.col(f"r.{_quoted(b)}") for a, b in zip(left_keys, right_keys)))
        return DataFrame(self.df.alias("l").join(right.df.alias("r"), on, _JOINS[how]))

    def union(self, other: "DataFrame", distinct: bool = False) -> "DataFrame":
        out = self.df.union(other.df)
        return DataFrame(out.distinct() if distinct else out)

    def union_distinct(self, other: "DataFrame") -> "DataFrame":
        return self.union(other, distinct=True)

    def intersect(self, other: "DataFrame") -> "DataFrame":
        """Rows of this frame that the other has; repeats stay, nulls equal nulls."""
        return DataFrame(self.df.alias("l").join(other.df.distinct().alias("r"), _null_safe(self.df, other.df), "left_semi"))

    def except_all(self, other: "DataFrame") -> "DataFrame":
        """Rows of this frame that the other lacks; a match drops every copy, nulls equal nulls."""
        return DataFrame(self.df.alias("l").join(other.df.distinct().alias("r"), _null_safe(self.df, other.df), "left_anti"))

    def describe(self) -> "DataFrame":
        """count, null_count, mean, std, min, max and median of every column, as text, from one aggregation."""
        numeric = {f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)}
        plain = {f.name for f in self.df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.BooleanType)}
        none = F.lit(None).cast("string")
        stats = {
            "count": lambda n, c: F.count(c).cast("double").cast("string"),
            "null_count": lambda n, c: F.sum(c.isNull().cast("int")).cast("double").cast("string"),
            "mean": lambda n, c: F.avg(c).cast("string") if n in numeric else none,
            "std": lambda n, c: F.stddev_samp(c).cast("string") if n in numeric else none,
            "min": lambda n, c: F.min(c).cast("string") if n in plain else none,
            "max": lambda n, c: F.max(c).cast("string") if n in plain else none,
            "median": lambda n, c: F.median(c).cast("string") if n in numeric else none,
        }
        names = self.df.columns
        one = self.df.agg(*(F.struct(*(fn(n, F.col(_quoted(n))).alias(f"c{i}") for i, n in enumerate(names))).alias(s) for s, fn in stats.items()))
        rows = F.explode(F.array(*(F.struct(F.lit(s).alias("describe"), F.col(s).alias("v")) for s in stats))).alias("x")
        return DataFrame(one.select(rows).select("x.describe", *(F.col(f"x.v.c{i}").alias(n) for i, n in enumerate(names))))

    def cache(self) -> "DataFrame":
        """Held from now on, in memory and, beyond it, on disk."""
        df = self.df.persist()
        df.count()
        return DataFrame(df)

    # introspection
    def schema(self) -> pa.Schema:
        return arrow_schema(self.df.schema)

    def explain(self, verbose: bool = False, analyze: bool = False) -> None:
        if analyze:
            self.df.write.format("noop").mode("overwrite").save()
        self.df.explain("extended" if verbose else "formatted")

    def execution_plan(self) -> ExecutionPlan:
        return ExecutionPlan(self.df._jdf.queryExecution().executedPlan(), self.df.rdd.getNumPartitions())

    def logical_plan(self) -> str:
        return self.df._jdf.queryExecution().analyzed().toString()

    def optimized_plan(self) -> str:
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def show(self, num: int = 20) -> None:
        print(f"DataFrame()\n{self._text(num)}")

    def _text(self, num: int) -> str:
        return self.df._jdf.showString(num, 0, False)

    def __repr__(self) -> str:
        return f"DataFrame()\n{self._text(10)}"

    # results
    def collect(self) -> list[pa.RecordBatch]:
        return self.to_arrow_table().to_batches()

    def collect_partitioned(self) -> list[list[pa.RecordBatch]]:
        """The batches of each partition, those without rows included."""
        rdd = self._packed()
        out: list[list[pa.RecordBatch]] = [[] for _ in range(rdd.getNumPartitions())]
        for row in rdd.collect():
            out[row.part] += _unpacked(row.data)
        return out

    def _packed(self):
        """The partitions' batches as bytes, encoded by the tasks; one RDD, so shuffles below it run once."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            for batch in batches:
                if batch.num_rows:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch)
                    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "data"])

        return self.df.mapInArrow(pack, "part int, data binary").rdd

    def to_arrow_table(self) -> pa.Table:
        return self.df.toArrow()

    def to_pandas(self):
        return self.to_arrow_table().to_pandas()

    def to_pylist(self) -> list[dict]:
        return self.to_arrow_table().to_pylist()

    def to_pydict(self) -> dict[str, list]:
        return self.to_arrow_table().to_pydict()

    def to_polars(self):
        import polars

        return polars.DataFrame(self.to_arrow_table())

    def count(self) -> int:
        return self.df.count()

    def execute_stream(self, batch_rows: int | None = None) -> RecordBatchStream:
        """Batches, of ``batch_rows`` at most, one partition after the other; the driver holds one partition's at a time."""
        batches = (b for row in self._packed().toLocalIterator(prefetchPartitions=True) for b in _unpacked(row.data))
        return RecordBatchStream(b.slice(i, batch_rows) for b in batches for i in range(0, b.num_rows, batch_rows)) if batch_rows else RecordBatchStream(batches)

    def execute_stream_partitioned(self) -> list[RecordBatchStream]:
        """A stream for each partition; each runs its own partition's task when it is read, on shuffles that are done once."""
        rdd = self._packed()

        def one(i: int) -> Iterator[pa.RecordBatch]:
            for row in rdd.context.runJob(rdd, list, [i]):
                yield from _unpacked(row.data)

        return [RecordBatchStream(one(i)) for i in range(rdd.getNumPartitions())]

    # sinks
    def write_parquet(self, path: str, compression: str = "uncompressed") -> None:
        """Compression: uncompressed, snappy, gzip, zstd, lz4, lz4_raw, and brotli and lzo where their codecs are installed; ``zstd(3)`` sets a level."""
        name, _, level = compression.lower().partition("(")
        writer = self.df.write.option("compression", name)
        if level:
            key = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}.get(name)
            if key:
                writer = writer.option(key, level.rstrip(")"))
        writer.parquet(path)

    def write_csv(self, path: str) -> None:
        self.df.write.option("header", True).csv(path)

    def write_json(self, path: str) -> None:
        self.df.write.json(path)

    # beyond the facade
    def transform(self, rule) -> "DataFrame":
        return DataFrame(rule(self.df))
