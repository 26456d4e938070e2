"""Scalar and aggregate functions by name."""

from larkspur.functions.library import FUNCTIONS, SQL_FUNCTIONS, call
from larkspur.functions.natives import greatest, hash_int, least

__all__ = ["FUNCTIONS", "SQL_FUNCTIONS", "call", "greatest", "hash_int", "least"]
