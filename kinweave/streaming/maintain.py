"""A closure kept up to date by a stream of edges.

A closure is no state that can be kept by key, so each micro-batch runs the
incremental operator on a table. Batches may come again after a failure: the
state of batch n is a table of its own, made from that of batch n - 1, so a
repeated batch gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.algebra import avos_product
from ..operators.closure import absorbed, semi_naive
from ..operators.linalg import add


def absorb(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """The closure ``(i, j, v)`` off the diagonal with a batch of new ``edges (i, j, v)``.

    Where all edges are one step, new paths are lengthened step by step. Else
    they alternate old paths and new edges: a new edge is widened by the old
    paths at both ends, and the widened edges are closed among themselves.
    """
    stepped = absorbed(closure, edges)
    if stepped is not None:
        return stepped
    new = edges.where("v >= 2").select("i", "j", "v")
    left = closure.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(new.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    wide = add(new, left.select("i", "j", avos_product("x", "y").alias("v")))
    right = wide.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(closure.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    wide = add(wide, right.select("i", "j", avos_product("x", "y").alias("v")))
    return add(closure, semi_naive(wide).paths)


def maintain(edges: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that keeps the closure of all ``edges`` so far under ``path/<batch>``."""

    def batch(part: DataFrame, number: int) -> None:
        spark: SparkSession = part.sparkSession
        before = spark.read.parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], "i long, j long, v long")
        absorb(before, part.select("i", "j", "v").distinct()).write.mode("overwrite").parquet(f"{path}/{number}")

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
