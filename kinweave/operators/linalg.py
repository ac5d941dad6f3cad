"""Vector and matrix products over the path algebra, as joins and aggregates.

A product is an equi-join on the shared index and a MIN per result cell; the
sum of matrices is a union and a MIN. MIN is partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import avos_product

#: Rows of a vector that are broadcast at most.
MAX_BROADCAST = 200_000


def _cell(df: DataFrame, *index: str) -> DataFrame:
    """One non-zero cell per index: the sum of its products."""
    return df.where("p <> 0").groupBy(*index).agg(F.min("p").alias("v"))


def _small(vector: DataFrame) -> DataFrame:
    """Broadcast a vector if it has few rows."""
    return F.broadcast(vector) if vector.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else vector


def dot(u: DataFrame, v: DataFrame) -> DataFrame:
    """The product of two vectors ``(k, v)``: one row ``(v)``, 0 if nothing meets."""
    both = u.select("k", F.col("v").alias("x")).join(v.select("k", F.col("v").alias("y")), "k")
    return both.select(avos_product("x", "y").alias("p")).where("p <> 0").agg(F.coalesce(F.min("p"), F.lit(0)).alias("v"))


def row_times(u: DataFrame, a: DataFrame) -> DataFrame:
    """Row vector by matrix: ``(k, v)``."""
    u = _small(u.select(F.col("k").alias("i"), F.col("v").alias("x")))
    both = a.select("i", "j", F.col("v").alias("y")).join(u, "i")
    return _cell(both.select(F.col("j").alias("k"), avos_product("x", "y").alias("p")), "k")


def times_column(a: DataFrame, v: DataFrame) -> DataFrame:
    """Matrix by column vector: ``(k, v)``."""
    v = _small(v.select(F.col("k").alias("j"), F.col("v").alias("y")))
    both = a.select("i", "j", F.col("v").alias("x")).join(v, "j")
    return _cell(both.select(F.col("i").alias("k"), avos_product("x", "y").alias("p")), "k")


def _products(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k")


def matmul(a: DataFrame, b: DataFrame, upper: bool = False, inner: tuple[int, int] | None = None) -> DataFrame:
    """Matrix product; ``upper`` asks only for cells on and over the diagonal. ``inner`` are the inner dimensions, which must agree."""
    if inner and inner[0] != inner[1]:
        raise ValueError(f"inner dimensions differ: {inner[0]} and {inner[1]}")
    both = _products(a, b)
    if upper:
        both = both.where("j >= i")
    return _cell(both.select("i", "j", avos_product("x", "y").alias("p")), "i", "j")


def pattern(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells ``(i, j)`` that a product may fill, without values."""
    return _products(a, b).select("i", "j").distinct()


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two matrices."""
    return a.select("i", "j", "v").unionByName(b.select("i", "j", "v")).where("v <> 0").groupBy("i", "j").agg(F.min("v").alias("v"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells ``(i, j, a, b)`` that differ; equal matrices have none."""
    left, right = a.select("i", "j", F.col("v").alias("a")), b.select("i", "j", F.col("v").alias("b"))
    return left.join(right, ["i", "j"], "full").where("not (a <=> b)")


def equal(a: DataFrame, b: DataFrame) -> bool:
    return differences(a.where("v <> 0"), b.where("v <> 0")).isEmpty()


def scale(a: DataFrame, factor: int) -> DataFrame:
    """Ordinary multiplication of all cells by a number."""
    return a.select("i", "j", (F.col("v") * F.lit(factor)).alias("v")).where("v <> 0")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def nnz(a: DataFrame) -> Column:
    """Aggregate: number of non-zero cells."""
    return F.count_if(F.col("v") != 0)


def offspring(red: DataFrame, black: DataFrame) -> DataFrame:
    """The row ``(k, v)`` of a child of two vertices with rows ``red`` and ``black``, by 2 x red + 3 x black.

    Their own cells are -1 in ``red`` and 1 in ``black``.
    """
    sides = [s.select("k", F.lit(c).cast("long").alias("x"), F.col("v").alias("y")) for s, c in ((red, 2), (black, 3))]
    both = sides[0].unionByName(sides[1])
    return _cell(both.select("k", avos_product("x", "y").alias("p")), "k")
