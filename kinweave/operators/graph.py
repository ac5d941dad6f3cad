"""The graph model: vertices with a colour, and typed edges to parents.

``vertices (vertex_id, color, ...)`` has colour -1 (red) or 1 (black);
``edges (i, j, v)`` has one row a pair, 2 to a red parent and 3 to a black one.
A matrix is a table ``(i, j, v)`` without rows for zero cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CycleError(ValueError):
    """A path leads back to ``vertex``."""

    def __init__(self, message: str, vertex: int | None = None):
        super().__init__(message)
        self.vertex = vertex


class DensificationError(ValueError):
    """A matrix is denser than sparse work allows."""


@dataclass
class Graph:
    """A two-coloured parentage graph.

    ``strict`` graphs have edges of value 2 and 3 only; others any from 2 on.
    """

    vertices: DataFrame
    edges: DataFrame
    strict: bool = True

    def matrix(self) -> DataFrame:
        """Edges and, on the diagonal, colours."""
        own = self.vertices.select(F.col("vertex_id").alias("i"), F.col("vertex_id").alias("j"), F.col("color").cast("long").alias("v"))
        return self.edges.select("i", "j", "v").unionByName(own)

    def check(self) -> "Graph":
        """Raise if a violation of :func:`violations` is there."""
        first = violations(self).first()
        if first:
            raise ValueError(f"{first['rule']} at ({first['i']}, {first['j']})")
        return self


def cells(df: DataFrame) -> DataFrame:
    """``(i, j, v)`` as longs, without zeros."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("i", "j", "v")]).where("v <> 0")


def off_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("i <> j")


def from_dense(rows: list[list[int]], spark) -> DataFrame:
    """A small dense matrix as cells."""
    data = [(i, j, int(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v]
    return spark.createDataFrame(data, "i long, j long, v long")


def wide_to_cells(df: DataFrame, row: str, columns: dict[str, int]) -> DataFrame:
    """A table with a column for each matrix column to cells; nulls and zeros are absent."""
    pairs = ", ".join(f"{j}L, cast(`{c}` as bigint)" for c, j in columns.items())
    return df.selectExpr(f"cast(`{row}` as bigint) as i", f"stack({len(columns)}, {pairs}) as (j, v)").where("v is not null and v <> 0")


def cells_to_wide(matrix: DataFrame, n: int, limit: int = 16_384) -> DataFrame:
    """A table with columns ``c0 .. c{n-1}``; absent cells are 0. Only for matrices of at most ``limit`` columns."""
    if n > limit:
        raise ValueError(f"a dense table has at most {limit} columns")
    return (
        matrix.groupBy("i")
        .pivot("j", list(range(n)))
        .agg(F.first("v"))
        .select("i", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(f"c{k}") for k in range(n)])
    )


def _violation(df: DataFrame, rule: str, i: str, j: str) -> DataFrame:
    number: Column = F.col(i).cast("long").alias("i")
    return df.select(F.lit(rule).alias("rule"), number, F.col(j).cast("long").alias("j"))


def violations(g: Graph, ordered: bool = False) -> DataFrame:
    """``(rule, i, j)`` of every broken rule of the model; ``ordered`` also asks for parents with smaller ids."""
    v, e = g.vertices.select("vertex_id", "color"), g.edges.select("i", "j", "v")
    parent = e.join(v.select(F.col("vertex_id").alias("j"), F.col("color").alias("pc")), "j", "left")
    found = [
        _violation(v.where("color is null or color not in (-1, 1)"), "color", "vertex_id", "vertex_id"),
        _violation(v.groupBy("vertex_id").count().where("count > 1"), "duplicate_vertex", "vertex_id", "vertex_id"),
        _violation(e.groupBy("i", "j").count().where("count > 1"), "duplicate_edge", "i", "j"),
        _violation(e.where("i = j"), "self_loop", "i", "j"),
        _violation(e.join(v, e["i"] == v["vertex_id"], "left_anti"), "unknown_child", "i", "j"),
        _violation(e.join(v, e["j"] == v["vertex_id"], "left_anti"), "unknown_parent", "i", "j"),
        _violation(e.where("v not in (2, 3)" if g.strict else "v < 2"), "edge_value", "i", "j"),
    ]
    if g.strict:
        found.append(_violation(parent.where("(v = 2 and pc <> -1) or (v = 3 and pc <> 1)"), "parent_color", "i", "j"))
        several = e.groupBy("i", "v").agg(F.count("*").alias("n"), F.min("j").alias("j")).where("n > 1")
        found.append(_violation(several, "parents_of_one_color", "i", "j"))
    if ordered:
        found.append(_violation(e.where("j >= i"), "parent_order", "i", "j"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
