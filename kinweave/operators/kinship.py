"""Kinship questions on a closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import consanguinity_sql, msb


def kinship(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, common_ancestor, relationship)`` for ``pairs (a, b)``.

    ``rows (i, j, v)`` is a closure with its diagonal. The common ancestor has
    the least sum of both values, a red self counting as -1, and the smallest id
    on ties; without one the ancestor is -1.
    """
    left = pairs.join(rows.select(F.col("i").alias("a"), "j", F.col("v").alias("x")), "a")
    both = left.join(rows.select(F.col("i").alias("b"), "j", F.col("v").alias("y")), ["b", "j"])
    best = both.groupBy("a", "b").agg(F.min(F.struct((F.col("x") + F.col("y")).alias("s"), "j", "x", "y")).alias("m"))
    out = pairs.join(best, ["a", "b"], "left").select("a", "b", "m", msb("m.x").alias("da"), msb("m.y").alias("db"))
    named = F.when(F.col("m").isNull(), "No Relationship").otherwise(F.expr(consanguinity_sql("da", "db")))
    return out.select("a", "b", F.coalesce("m.j", F.lit(-1)).cast("long").alias("common_ancestor"), named.alias("relationship"))


def ancestors(closure: DataFrame, vertex: int) -> DataFrame:
    """The row of a vertex: ``(vertex_id, v)``."""
    return closure.where((F.col("i") == vertex) & (F.col("j") != vertex)).select(F.col("j").alias("vertex_id"), "v")


def descendants(closure: DataFrame, vertex: int) -> DataFrame:
    """The column of a vertex: ``(vertex_id, v)``."""
    return closure.where((F.col("j") == vertex) & (F.col("i") != vertex)).select(F.col("i").alias("vertex_id"), "v")


def are_ancestors(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs (a, b)`` of which ``b`` is an ancestor of ``a``."""
    return pairs.join(closure.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b")), ["a", "b"], "left_semi")


def siblings(edges: DataFrame) -> DataFrame:
    """``(a, b, shared)``, a < b: 2 shared parents for full siblings, 1 for half."""
    child = edges.select(F.col("i").alias("a"), "j").distinct()
    both = child.join(child.select(F.col("a").alias("b"), "j"), "j").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


def related_within(closure: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """``pairs (a, b)`` that are one another's ancestors or share one, up to ``depth`` generations on both sides."""
    near = closure.where("i <> j").where(msb("v") <= depth).select("i", "j")
    own = near.select("i").union(near.select("j")).distinct().select(F.col("i"), F.col("i").alias("j"))
    reach = near.unionByName(own)
    mine = pairs.select("a", "b").distinct().join(reach.select(F.col("i").alias("a"), "j"), "a")
    return mine.join(reach.select(F.col("i").alias("b"), "j"), ["b", "j"]).select("a", "b").distinct()
