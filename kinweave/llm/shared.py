"""What the operators share: written tables in the shared folder, worker imports."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from ..plans import scratch

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package, wherever it was started.

    On a cluster the package is installed or shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


class Scratch(scratch.Scratch):
    """Tables written to the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        importable(spark)
        super().__init__(spark, label)
