"""File sources and sinks: Parquet, CSV, JSON, and Arrow data in memory."""

from __future__ import annotations

import io
import lzma
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.runtime import shared_folder
from larkspur.sources.object_stores import hadoop_options, hadoop_path
from larkspur.types import normalise, spark_schema

_CODECS = {"gzip": ".gz", "gz": ".gz", "bz2": ".bz2", "bzip2": ".bz2", "xz": ".xz", "zstd": ".zst", "zst": ".zst"}


def _located(spark: SparkSession, path: str, options: dict[str, str] | None) -> tuple[str, dict[str, str]]:
    """The path as Spark reads it, and the reader's own options for its store: they hold for this reader alone."""
    if path.startswith(("http://", "https://")):
        if options:
            raise ValueError("http paths take no storage options")
        return _fetched(spark, path), {}
    own = hadoop_options(path, options)
    scheme = hadoop_path(path).partition("://")[0]
    # A connection made with one reader's keys must not serve another's.
    return hadoop_path(path), {**own, f"fs.{scheme}.impl.disable.cache": "true"} if own else {}


def _fetched(spark: SparkSession, url: str) -> str:
    """A copy of what a web server has, in the folder that all machines share."""
    folder = shared_folder(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = url.partition("?")[0].rstrip("/").rpartition("/")[2] or "data"
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/web/{uuid.uuid4().hex}/{name}")
    system = target.getFileSystem(conf)
    source = jvm.java.net.URI(url).toURL().openStream()
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, system.create(target), 1 << 20, True)
    system.deleteOnExit(target.getParent())
    return target.toString()


def _is_dir(spark: SparkSession, path: str, options: dict[str, str]) -> bool:
    """Whether a path, in whatever store, is a folder."""
    if any(c in path for c in "*?[{"):
        return False
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for key, value in options.items():
        conf.set(key, value)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def read_parquet(spark: SparkSession, path: str, *, partition_cols: list[tuple[str, str]] | None = None, pruning: bool = True, extension: str = ".parquet", schema: pa.Schema | None = None, storage_options: dict[str, str] | None = None) -> DataFrame:
    """A Parquet file or folder. Hive partition columns have to be strings. Without ``pruning`` row groups aren't skipped by their statistics."""
    for name, kind in partition_cols or []:
        if kind != "string":
            raise ValueError(f"partition column {name} has to be a string, not {kind}")
    target, options = _located(spark, path, storage_options)
    reader = spark.read.options(**options)
    if not pruning:
        reader = reader.option("parquet.filter.stats.enabled", "false").option("parquet.filter.columnindex.enabled", "false").option("parquet.filter.dictionary.enabled", "false").option("parquet.filter.bloom.enabled", "false")
    if _is_dir(spark, target, options):
        reader = reader.option("pathGlobFilter", f"*{extension}")
    if schema is not None or partition_cols:
        fields = spark_schema(schema) if schema is not None else reader.parquet(target).schema
        named = {name for name, _ in partition_cols or []}
        fields = T.StructType([f for f in fields if f.name not in named] + [T.StructField(n, T.StringType()) for n, _ in partition_cols or []])
        reader = reader.schema(fields)
    return reader.parquet(target)


def read_csv(
    spark: SparkSession, path: str, *, schema: pa.Schema | None = None, has_header: bool = True, delimiter: str = ",", infer_rows: int = 1000, extension: str = ".csv", compression: str | None = None, storage_options: dict[str, str] | None = None, newlines_in_values: bool | None = None
) -> DataFrame:
    """A CSV file or folder; without a schema, types come from the first ``infer_rows`` lines.

    A later value that doesn't fit its type, or a line of another number of
    fields, fails the query that meets it. ``newlines_in_values`` says whether
    quoted values hold line ends: files are then read whole, one a task. Unless
    it is given, the first lines decide, by a quote that stays open at an end.
    """
    if len(delimiter.encode()) != 1:
        raise ValueError(f"a delimiter is one byte, not {delimiter!r}")
    if compression is not None and compression.lower() not in _CODECS:
        raise ValueError(f"Unsupported compression {compression!r}; use gzip, bz2, xz or zstd")
    suffix = extension + (_CODECS[compression.lower()] if compression else "")
    target, store = _located(spark, path, storage_options)
    options = {"header": str(has_header).lower(), "sep": delimiter, "mode": "FAILFAST"}
    if _is_dir(spark, target, store):
        store = {**store, "pathGlobFilter": f"*{suffix}"}
    packed = suffix.endswith(".xz") or target.endswith(".xz")
    lines = _xz_lines(spark, target, store) if packed else spark.read.options(**store).text(target)
    head = [r[0] for r in lines.take(infer_rows + has_header)]
    if newlines_in_values is None:
        newlines_in_values = any(line.count('"') % 2 for line in head)
    if packed and newlines_in_values:
        raise ValueError("values with line ends can't be read from xz files")
    if newlines_in_values:
        options["multiLine"] = "true"
        head = _whole(head)
    if schema is not None:
        fields = spark_schema(schema)
    else:
        fields = spark.read.options(**options, inferSchema="true").csv(spark.sparkContext.parallelize(head, 1)).schema
    reader = spark.read.options(**options).schema(fields)
    return reader.csv(lines.rdd.map(lambda r: r[0])) if packed else reader.options(**store).csv(target)


def _whole(lines: list[str]) -> list[str]:
    """Lines of which a quoted value goes on in the next one, joined."""
    out: list[str] = []
    for line in lines:
        if out and out[-1].count('"') % 2:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def _xz_lines(spark: SparkSession, target: str, options: dict[str, str]) -> DataFrame:
    """Lines of .xz files, for which Hadoop has no codec: each file is unpacked by one task, some bytes at a time."""

    def unpack(batches):
        for batch in batches:
            for blob in batch.column("content"):
                data, rest = io.BytesIO(blob.as_buffer()), b""
                with lzma.open(data) as file:
                    while piece := file.read(1 << 22):
                        *lines, rest = (rest + piece).split(b"\n")
                        if lines:
                            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode() for x in lines], pa.string())], ["value"])
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([rest.removesuffix(b"\r").decode()], pa.string())], ["value"])

    return spark.read.format("binaryFile").options(**options).load(target).select("content").mapInArrow(unpack, "value string")


def read_json(spark: SparkSession, path: str, *, schema: pa.Schema | None = None, storage_options: dict[str, str] | None = None) -> DataFrame:
    """Newline-delimited JSON."""
    target, options = _located(spark, path, storage_options)
    reader = spark.read.options(**options)
    return (reader.schema(spark_schema(schema)) if schema is not None else reader).json(target)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Arrow data in memory; times without a zone stay without one."""
    schema = spark_schema(table.schema)
    return spark.createDataFrame(normalise(table), schema=schema)
