"""Metadata records."""

from __future__ import annotations

from dataclasses import dataclass, field

from larkspur.types import DataType, DataTypeMap, PythonType, RexType, SqlType

__all__ = ["DFSchema", "DataType", "DataTypeMap", "PythonType", "RexType", "SqlFunction", "SqlSchema", "SqlStatistics", "SqlTable", "SqlType", "SqlView"]


@dataclass
class DFSchema:
    names: list[str] = field(default_factory=list)

    @classmethod
    def empty(cls) -> "DFSchema":
        return cls()

    def field_names(self) -> list[str]:
        return self.names


@dataclass
class SqlStatistics:
    row_count: float

    def getRowCount(self) -> float:  # noqa: N802
        return self.row_count


@dataclass
class SqlTable:
    name: str
    columns: list[tuple[str, DataTypeMap]]
    row_count: float = 0.0
    filepaths: list[str] | None = None
    primary_key: str | None = None
    foreign_keys: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    constraints: list[str] = field(default_factory=list)

    @property
    def statistics(self) -> SqlStatistics:
        return SqlStatistics(self.row_count)


@dataclass
class SqlView:
    name: str
    definition: str


@dataclass
class SqlFunction:
    name: str
    return_types: dict = field(default_factory=dict)
    aggregation: bool = False

    def add_type_mapping(self, input_types: list, return_type: DataTypeMap) -> None:
        self.return_types[tuple(str(t) for t in input_types)] = return_type


@dataclass
class SqlSchema:
    name: str
    tables: list[SqlTable] = field(default_factory=list)
    views: list[SqlView] = field(default_factory=list)
    functions: list[SqlFunction] = field(default_factory=list)

    def table_by_name(self, name: str) -> SqlTable | None:
        return next((t for t in self.tables if t.name == name), None)

    def add_table(self, table: SqlTable) -> None:
        self.tables.append(table)

    def drop_table(self, name: str) -> None:
        self.tables = [t for t in self.tables if t.name != name]
