"""Registered queries of the engine's operators, with their SQL."""

from __future__ import annotations

from larkspur.queries import analytic, relational, scalars, storage
from larkspur.queries.registry import QUERIES, SQL, context

__all__ = ["QUERIES", "SQL", "analytic", "flagship", "relational", "scalars", "storage"]


def flagship(spark, sf_dir):
    """Revenue by customer nation of the orders of 1995."""
    return context(spark, sf_dir).sql(FLAGSHIP).df


FLAGSHIP = """
    SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE year(o_orderdate) = 1995 GROUP BY n_name
"""
QUERIES["flagship_revenue"] = flagship
SQL["flagship_revenue"] = FLAGSHIP
