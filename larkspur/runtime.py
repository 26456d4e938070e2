"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="larkspur-src-"), "larkspur.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"larkspur/{path.relative_to(root)}")
    sc.addPyFile(target)
    sc._larkspur_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or else the context's checkpoint folder; a temporary one where neither is set (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")
