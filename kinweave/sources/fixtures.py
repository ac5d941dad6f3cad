"""Graphs that are pure functions of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parity(c: str) -> Column:
    return F.when(F.col(c) % 2 == 0, -1).otherwise(1)


def _edges(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """Rows of several edges each: ``(child, parent, value)`` expressions."""
    structs = ", ".join(f"struct(cast({i} as bigint) as i, cast({j} as bigint) as j, cast({v} as bigint) as v)" for i, j, v in pairs)
    return df.selectExpr(f"inline(array({structs}))")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts by key: from 6 on a red parent at 2 (k div 4) and a black one at 2 (k div 6) + 1."""
    k = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    return Graph(
        k.select(F.col("k").alias("vertex_id"), _parity("k").alias("color")),
        _edges(k.where("k >= 6"), ("k", "2 * (k div 4)", "2"), ("k", "2 * (k div 6) + 1", "3")),
    )


def part7_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Seven such graphs side by side, by the remainder of the key."""
    k = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) k", "cast(p_partkey div 7 as bigint) q", "cast(p_partkey % 7 as bigint) r")
    return Graph(
        k.select(F.col("k").alias("vertex_id"), _parity("q").alias("color")),
        _edges(k.where("q >= 6"), ("k", "7 * (2 * (q div 4)) + r", "2"), ("k", "7 * (2 * (q div 6) + 1) + r", "3")),
    )


def conversation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A chain for each conversation: each turn's parent is the turn before."""
    t = _table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn as k", "conv_id", "turn", "case when role = 'assistant' then -1 else 1 end as color")
    before = t.selectExpr("conv_id", "turn + 1 as turn", "k as j", "case when color = -1 then 2L else 3L end as v")
    return Graph(t.selectExpr("k as vertex_id", "color"), t.join(before, ["conv_id", "turn"]).selectExpr("k as i", "j", "v"))


def cyclic_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The part graph with an edge 2 to 199, which closes cycles."""
    g = part_graph(spark, sf_dir)
    return Graph(g.vertices, g.edges.unionByName(spark.range(1).selectExpr("2L as i", "199L as j", "3L as v")))


#: Offsets of the tables in the ids of the foreign-key graph.
OFFSETS = {"region": 0, "nation": 1_000, "customer": 10_000_000, "supplier": 1_000_000_000, "orders": 10_000_000_000}


def key_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``vertices (id, given_name, surname, iteration)`` and typed ``edges (source, destination, type)`` of the foreign keys.

    Types: an order's customer is BiologicalParent or, by the remainder of its
    key, another type; a customer's nation is AssumedBiological, a supplier's
    StepParent, a nation's region UntypedParent.
    """
    o = OFFSETS
    orders = _table(spark, sf_dir, "orders").selectExpr(
        f"cast(o_orderkey as bigint) + {o['orders']} as source",
        f"cast(o_custkey as bigint) + {o['customer']} as destination",
        "case o_orderkey % 5 when 0 then 'AdoptiveParent' when 1 then 'FosterParent' when 2 then 'UnspecifiedParentType' when 3 then 'OtherParent' else 'BiologicalParent' end as type",
    )
    customers = _table(spark, sf_dir, "customer").selectExpr(f"cast(c_custkey as bigint) + {o['customer']} as source", f"cast(c_nationkey as bigint) + {o['nation']} as destination", "'AssumedBiological' as type")
    suppliers = _table(spark, sf_dir, "supplier").selectExpr(f"cast(s_suppkey as bigint) + {o['supplier']} as source", f"cast(s_nationkey as bigint) + {o['nation']} as destination", "'StepParent' as type")
    nations = _table(spark, sf_dir, "nation").selectExpr(f"cast(n_nationkey as bigint) + {o['nation']} as source", "cast(n_regionkey as bigint) as destination", "'UntypedParent' as type")
    vertices = [
        _table(spark, sf_dir, t).selectExpr(f"cast({key} as bigint) + {o[t]} as id", f"'{t}' as given_name", f"cast({key} as string) as surname", f"{hop}L as iteration")
        for t, key, hop in (("region", "r_regionkey", 3), ("nation", "n_nationkey", 2), ("customer", "c_custkey", 1), ("supplier", "s_suppkey", 1), ("orders", "o_orderkey", 0))
    ]
    out = vertices[0]
    for v in vertices[1:]:
        out = out.unionByName(v)
    return out, orders.unionByName(customers).unionByName(suppliers).unionByName(nations)
