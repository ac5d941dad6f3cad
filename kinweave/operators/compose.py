"""Incremental maintenance of a closure: one more vertex, one more edge.

The closure is a matrix with its diagonal. Neither operation recomputes it:
a vector product gives the new row and column, and their outer product is
summed into the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import avos_product
from .graph import CycleError
from .linalg import _small, add, row_times, times_column


def vertex_cycle(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """``(k, u, v)``: vertices that would be ancestor and descendant of the new one."""
    return ancestors.select("k", F.col("v").alias("u")).join(descendants, "k").where("u <> 0 and v <> 0").select("k", "u", "v")


def add_vertex(closure: DataFrame, row: DataFrame, column: DataFrame, vertex: int, color: int, complete: bool = True) -> DataFrame:
    """The closure with ``vertex``; ``row (k, v)`` are its parents and ``column (k, v)`` its children.

    ``complete=False`` takes row and column as already composed with the closure.
    """
    if color not in (-1, 1):
        raise ValueError("a colour is -1 or 1")
    up = row_times(row, closure) if complete else row
    down = times_column(closure, column) if complete else column
    bad = vertex_cycle(up, down).orderBy("k").first()
    if bad:
        raise CycleError(f"Error: the new vertex would close a cycle. Idx: {bad['k']}, u_i: {bad['u']}, v_i: {bad['v']}", bad["k"])
    through = down.select(F.col("k").alias("i"), F.col("v").alias("x")).crossJoin(_small(up.select(F.col("k").alias("j"), F.col("v").alias("y"))))
    through = through.select("i", "j", avos_product("x", "y").alias("v"))
    here = F.lit(vertex).cast("long")
    own = closure.sparkSession.range(1).select(here.alias("i"), here.alias("j"), F.lit(color).cast("long").alias("v"))
    border = up.select(here.alias("i"), F.col("k").alias("j"), "v").unionByName(down.select(F.col("k").alias("i"), here.alias("j"), "v")).unionByName(own)
    return add(closure, through).unionByName(border)


def edge_cycle(closure: DataFrame, alpha: int, beta: int) -> bool:
    """Whether an edge from ``alpha`` to ``beta`` would close a cycle."""
    return alpha == beta or not closure.where((F.col("i") == beta) & (F.col("j") == alpha) & (F.col("v") != 0)).isEmpty()


def add_edge(closure: DataFrame, alpha: int, beta: int, value: int, guard: bool = True) -> DataFrame:
    """The closure with an edge of ``value`` from ``alpha`` to ``beta``.

    Row ``alpha`` is replaced by its product with the closure, the edge put into
    it; all other rows gain what they reach through ``alpha``.
    """
    if guard and edge_cycle(closure, alpha, beta):
        raise CycleError("Error: cycle detected!", alpha)
    row = closure.where((F.col("i") == alpha) & (F.col("j") != beta)).select(F.col("j").alias("k"), "v")
    edge = closure.sparkSession.range(1).select(F.lit(beta).cast("long").alias("k"), F.lit(value).cast("long").alias("v"))
    up = row_times(row.unionByName(edge), closure)
    others = closure.where(F.col("i") != alpha)
    reach = others.where(F.col("j") == alpha).select("i", F.col("v").alias("x"))
    through = reach.crossJoin(_small(up.select(F.col("k").alias("j"), F.col("v").alias("y"))))
    gained = add(others, through.select("i", "j", avos_product("x", "y").alias("v")))
    return gained.unionByName(up.select(F.lit(alpha).cast("long").alias("i"), F.col("k").alias("j"), "v"))
