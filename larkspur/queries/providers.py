"""A table provider over Arrow rows in memory."""

from __future__ import annotations

import pyarrow as pa

from larkspur.sources.python_sources import AbstractTableProvider


class Rows(AbstractTableProvider):
    def __init__(self, table: pa.Table):
        self.table = table

    def schema(self) -> pa.Schema:
        return self.table.schema

    def scan(self, filters=None) -> pa.Table:
        out = self.table
        for f in filters or ():
            out = out.filter(f)
        return out
