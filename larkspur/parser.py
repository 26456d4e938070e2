"""Parsing SQL to plans."""

from larkspur.plans import ContextProvider, parse_sql

__all__ = ["ContextProvider", "parse_sql"]
