"""Closures of the fixture graphs as materialised views, one a session and folder.

Queries about a closure share one written table, as users keep one; the queries
that test closures build their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.closure import transitive_closure
from ..operators.structure import identity
from ..sources import fixtures

_views: dict[tuple[str, str, str], DataFrame] = {}


def closure_of(spark: SparkSession, sf_dir: str, graph: str = "part_graph") -> DataFrame:
    """Paths ``(i, j, v)`` off the diagonal."""
    key = (spark.sparkContext.applicationId, sf_dir, graph)
    if key not in _views:
        _views[key] = transitive_closure(getattr(fixtures, graph)(spark, sf_dir).edges).paths
    return _views[key]


def closed_matrix(spark: SparkSession, sf_dir: str, graph: str = "part_graph") -> DataFrame:
    """The same with its diagonal."""
    return closure_of(spark, sf_dir, graph).unionByName(identity(getattr(fixtures, graph)(spark, sf_dir).vertices))
