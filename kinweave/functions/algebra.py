"""The path algebra as Spark columns, and the same rules as SQL text.

A relationship value names a typed path: 0 is none, -1 and 1 are a vertex's own
colour (red, black), a value from 2 on is a path whose bits after the leading
one are its steps: 0 to the red parent, 1 to the black one. The sum of two
values is the smaller of the non-zero ones, the product joins two paths.

The rules are written once, over the names of two columns, for Spark and for
DuckDB; they differ only in how a shift is spelled.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RED, BLACK = -1, 1
#: Bits of a path that fit a signed 64-bit value after its leading one.
MAX_GENERATIONS = 62


def _shift(x: str, n: str, dialect: str) -> str:
    return f"shiftleft({x}, cast({n} AS int))" if dialect == "spark" else f"(({x})::BIGINT << ({n})::BIGINT)"


def _fail(message: str, dialect: str) -> str:
    return f"cast(raise_error('{message}') AS bigint)" if dialect == "spark" else f"error('{message}')::BIGINT"


def msb_sql(x: str) -> str:
    """Position of the top bit; 0 for -1, 0 and 1. Exact up to 63 bits, unlike a logarithm."""
    return f"(CASE WHEN {x} <= 1 THEN 0 ELSE length(bin({x})) - 1 END)"


def sum_sql(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN {y} WHEN {y} = 0 THEN {x} ELSE least({x}, {y}) END)"


def lt_sql(x: str, y: str) -> str:
    """Order in which 0, no path, comes after all others."""
    return f"(CASE WHEN {x} = 0 THEN false WHEN {y} = 0 THEN true ELSE {x} < {y} END)"


def join_sql(x: str, y: str, dialect: str = "spark") -> str:
    """Concatenation of two proper paths."""
    tail = f"({y} - {_shift('1L' if dialect == 'spark' else '1', msb_sql(y), dialect)})"
    return f"({_shift(x, msb_sql(y), dialect)} + {tail})"


def product_sql(x: str, y: str, dialect: str = "spark") -> str:
    """The product of two values; raises for values under -1 and for paths that do not fit."""
    return f"""(CASE
      WHEN {x} < -1 OR {y} < -1 THEN {_fail("relationship values below -1 are undefined", dialect)}
      WHEN {x} = 0 OR {y} = 0 THEN 0
      WHEN {x} = -1 THEN (CASE WHEN {y} = 1 THEN 0 WHEN {y} = -1 THEN -1 ELSE {y} END)
      WHEN {x} = 1 THEN (CASE WHEN {y} = -1 THEN 0 ELSE {y} END)
      WHEN {y} = -1 THEN (CASE WHEN {x} % 2 = 0 THEN {x} ELSE 0 END)
      WHEN {y} = 1 THEN (CASE WHEN {x} % 2 = 1 THEN {x} ELSE 0 END)
      WHEN {msb_sql(x)} + {msb_sql(y)} > {MAX_GENERATIONS} THEN {_fail("path does not fit 63 bits", dialect)}
      ELSE {join_sql(x, y, dialect)} END)"""


def msb(x: str) -> Column:
    return F.expr(msb_sql(x))


def avos_sum(x: str, y: str) -> Column:
    return F.expr(sum_sql(x, y))


def avos_product(x: str, y: str) -> Column:
    return F.expr(product_sql(x, y))


def steps_sql(v: str, dialect: str = "spark") -> str:
    """The steps of a path as a string over r and b, from the vertex outwards."""
    return f"(CASE WHEN {v} <= 1 THEN '' ELSE translate(substring(bin({v}), 2), '01', 'rb') END)"


def steps(v: str) -> Column:
    """The steps of a path as an array; empty for values up to 1."""
    return F.expr(f"CASE WHEN {v} <= 1 THEN cast(array() AS array<string>) ELSE split({steps_sql(v)}, '') END")


def describe_sql(v: str) -> str:
    """Sex and generation that a value names."""
    g = msb_sql(v)
    return f"""(CASE WHEN {v} = -1 THEN 'RED_ONE (male identity)' WHEN {v} = 1 THEN 'BLACK_ONE (female identity)' WHEN {v} = 0 THEN 'NULL'
      ELSE concat(CASE WHEN {v} % 2 = 1 THEN 'female ' ELSE 'male ' END,
        CASE WHEN {g} = 1 THEN 'parent' ELSE concat(repeat('great-', cast({g} - 2 AS int)), 'grandparent') END) END)"""


def _cousin_sql(n: str) -> str:
    return f"CASE {n} WHEN 2 THEN '1st cousin' WHEN 3 THEN '2nd cousin' WHEN 4 THEN '3rd cousin' ELSE concat(cast({n} - 1 AS {{text}}), 'th cousin') END"


def consanguinity_sql(da: str, db: str, dialect: str = "spark") -> str:
    """The name of a relationship by the distances of both sides to the common ancestor.

    Fixed behaviour: distance 0 on both sides is named like a direct ancestor of
    removal 0, and (1, 3) is a "0th cousin 2 removed".
    """
    text = "string" if dialect == "spark" else "VARCHAR"
    far, near = f"abs({da} - {db})", f"least({da}, {db})"
    cousin = _cousin_sql(near).format(text=text)
    return f"""(CASE
      WHEN {da} = 0 OR {db} = 0 THEN CASE {far} WHEN 1 THEN 'parent' WHEN 2 THEN 'grandparent' WHEN 3 THEN 'great grandparent'
        ELSE concat(CASE {far} WHEN 4 THEN '2nd' WHEN 5 THEN '3rd' ELSE concat(cast({far} - 2 AS {text}), 'th') END, ' great grandparent') END
      WHEN {near} = 1 AND {far} = 0 THEN 'sibling'
      WHEN {near} = 1 AND {far} = 1 THEN 'aunt/uncle'
      WHEN {far} = 0 THEN {cousin}
      ELSE concat({cousin}, ' ', cast({far} AS {text}), ' removed') END)"""


def from_unsigned(v: str, bits: int) -> Column:
    """A value read from an unsigned type of ``bits`` bits, whose largest value stands for red."""
    if bits not in (8, 16, 32, 64):
        raise ValueError("unsigned types have 8, 16, 32 or 64 bits")
    top = F.lit((1 << bits) - 1).cast("decimal(20,0)")
    return F.when(F.col(v).cast("decimal(20,0)") == top, F.lit(RED)).otherwise(F.col(v)).cast("long")


def red_one(bits: int, signed: bool) -> int:
    """The value that stands for red in an integer type."""
    return -1 if signed else (1 << bits) - 1


def register(spark: SparkSession) -> None:
    """The scalar functions for SQL users, as expressions that Catalyst inlines."""
    signatures = {
        "avos_sum": ("x BIGINT, y BIGINT", "BIGINT", sum_sql("x", "y")),
        "avos_product": ("x BIGINT, y BIGINT", "BIGINT", product_sql("x", "y")),
        "avos_lt": ("x BIGINT, y BIGINT", "BOOLEAN", lt_sql("x", "y")),
        "avos_msb": ("x BIGINT", "INT", msb_sql("x")),
        "avos_steps": ("x BIGINT", "STRING", steps_sql("x")),
        "avos_describe": ("x BIGINT", "STRING", describe_sql("x")),
        "avos_consanguinity": ("da INT, db INT", "STRING", consanguinity_sql("da", "db")),
    }
    for name, (arguments, result, body) in signatures.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
