"""Window helpers that Spark has no frame for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, aggregate: Callable[[], Column], partition_by: list[str], order_by: list[Column], preceding: int, following: int, alias: str) -> DataFrame:
    """An aggregate over a GROUPS frame: from ``preceding`` peer groups before to ``following`` after.

    Peer groups are numbered with dense_rank, and the frame is a range of these numbers.
    """
    rank = "__group"
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    frame = Window.partitionBy(*partition_by).orderBy(rank).rangeBetween(-preceding, following)
    return ranked.withColumn(alias, aggregate().over(frame)).drop(rank)
