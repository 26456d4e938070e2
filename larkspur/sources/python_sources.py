"""Python data sources: pyarrow datasets, table providers and deferred foreign tables.

Each is handed to Spark as a pickled object; partitions are read in Python
workers and come back as Arrow batches. A reader's error fails the query.
"""

from __future__ import annotations

import base64
import functools
from abc import ABCMeta, abstractmethod
from collections.abc import Iterable, Iterator
from typing import Any


import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from larkspur.sources.predicates import split, to_arrow, to_foreign
from larkspur.types import normalise, spark_schema


class AbstractTableProvider(metaclass=ABCMeta):
    """A user's table: ``schema()`` gives its Arrow schema, ``scan(filters)`` its rows.

    ``filters`` are pyarrow expressions that the provider has to apply in full;
    ``scan`` returns a table, a batch reader, or batches.
    """

    @abstractmethod
    def schema(self) -> pa.Schema: ...

    @abstractmethod
    def scan(self, filters: Any = None) -> Any: ...


def _pack(value: Any) -> str:
    return base64.b64encode(cloudpickle.dumps(value)).decode()


def _batches(got: Any) -> Iterator[pa.RecordBatch]:
    if isinstance(got, pa.RecordBatch):
        got = [got]
    elif isinstance(got, pa.Table):
        got = got.to_batches()
    elif hasattr(got, "to_pyarrow_batches"):
        got = got.to_pyarrow_batches()
    return iter(got)


def _shaped(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from normalise(pa.Table.from_batches([batch]).select(names)).combine_chunks().to_batches()


class _Reader(ds.DataSourceReader):
    def __init__(self, names: list[str]):
        self.names, self.filters = names, []

    def translate(self, f: ds.Filter) -> Any:
        return to_arrow(f)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        taken, left = split(filters, self.translate)
        self.filters = taken
        return left


def _all(filters: list[Any]) -> Any:
    return functools.reduce(lambda a, b: a & b, filters) if filters else None


class _DatasetReader(_Reader):
    """A partition for each file fragment that the filters leave."""

    def __init__(self, dataset: Any, names: list[str]):
        super().__init__(names)
        self.dataset = dataset

    def partitions(self) -> list[ds.InputPartition]:
        return [ds.InputPartition(f) for f in self.dataset.get_fragments(filter=_all(self.filters))] or [ds.InputPartition(None)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            batches = partition.value.scanner(schema=self.dataset.schema, columns=self.names, filter=_all(self.filters)).to_batches()
            yield from _shaped(batches, self.names)


class _ProviderReader(_Reader):
    def __init__(self, provider: Any, names: list[str]):
        super().__init__(names)
        self.provider = provider

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _shaped(_batches(self.provider.scan(filters=tuple(self.filters) or None)), self.names)


class _ForeignReader(_Reader):
    def __init__(self, table: Any, names: list[str]):
        super().__init__(names)
        self.table = table

    def translate(self, f: ds.Filter) -> Any:
        to_foreign(f, self.table)
        return f

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        own = [to_foreign(f, self.table) for f in self.filters]
        yield from _shaped(_batches(self.table.filter(*own) if own else self.table), self.names)


class PythonTable(ds.DataSource):
    """The data source behind all three; options carry the kind, the object and its schema."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_python"

    def _loaded(self) -> tuple[str, Any, pa.Schema]:
        return cloudpickle.loads(base64.b64decode(self.options["object"]))

    def schema(self) -> T.StructType:
        return spark_schema(self._loaded()[2])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        kind, value, _ = self._loaded()
        return {"dataset": _DatasetReader, "provider": _ProviderReader, "foreign": _ForeignReader}[kind](value, schema.names)


def read_python(spark: SparkSession, kind: str, value: Any, schema: pa.Schema) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PythonTable)
    return spark.read.format("larkspur_python").option("object", _pack((kind, value, schema))).load()
