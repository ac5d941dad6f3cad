"""All registered queries of the library, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..operators import closure as C
from ..operators import compose, kinship, linalg, quality, structure, synth, walk
from ..operators.einsum import einsum
from ..operators.graph import CycleError, cells_to_wide, violations, wide_to_cells
from ..sources import files, fixtures
from ..streaming.maintain import absorb
from .scratch import Scratch
from .views import closed_matrix, closure_of

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

# Named pieces of SQL, for the oracles.
_PART = """v AS (SELECT p_partkey AS vertex_id, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END::BIGINT AS color FROM part),
e AS (SELECT p_partkey AS i, 2 * (p_partkey // 4) AS j, 2::BIGINT AS v FROM part WHERE p_partkey >= 6
  UNION ALL SELECT p_partkey, 2 * (p_partkey // 6) + 1, 3::BIGINT FROM part WHERE p_partkey >= 6)"""
_PART7 = """v AS (SELECT p_partkey AS vertex_id, CASE WHEN (p_partkey // 7) % 2 = 0 THEN -1 ELSE 1 END::BIGINT AS color FROM part),
e AS (SELECT p_partkey AS i, 7 * (2 * ((p_partkey // 7) // 4)) + p_partkey % 7 AS j, 2::BIGINT AS v FROM part WHERE p_partkey // 7 >= 6
  UNION ALL SELECT p_partkey, 7 * (2 * ((p_partkey // 7) // 6) + 1) + p_partkey % 7, 3::BIGINT FROM part WHERE p_partkey // 7 >= 6)"""
_CONV = """t0 AS (SELECT conv_id * 100 + turn AS k, conv_id, turn, CASE WHEN role = 'assistant' THEN -1 ELSE 1 END::BIGINT AS color FROM conversations),
v AS (SELECT k AS vertex_id, color FROM t0),
e AS (SELECT a.k AS i, b.k AS j, CASE WHEN b.color = -1 THEN 2 ELSE 3 END::BIGINT AS v FROM t0 a JOIN t0 b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""
_CYC = _PART.replace("e AS (", "e0 AS (") + ",\ne AS (SELECT * FROM e0 UNION ALL SELECT 2, 199, 3)"
_MATRIX = "m AS (SELECT i, j, v FROM e UNION ALL SELECT vertex_id, vertex_id, color FROM v)"


def _close(edges: str = "e") -> str:
    return f"""t AS (SELECT i, j, v FROM {edges} UNION SELECT t.i, n.j, t.v * 2 + (n.v - 2) FROM t JOIN {edges} n ON t.j = n.i),
c AS (SELECT i, j, min(v) AS v FROM t GROUP BY i, j), cm AS (SELECT * FROM c UNION ALL SELECT vertex_id, vertex_id, color FROM v)"""


_REACH = "r AS (SELECT vertex_id AS a, vertex_id AS b FROM v UNION SELECT r.a, n.b FROM r JOIN (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e) n ON n.a = r.b),\nroot AS (SELECT a AS vertex_id, min(b) AS root FROM r GROUP BY a),\ncomp AS (SELECT vertex_id, dense_rank() OVER (ORDER BY root) - 1 AS component FROM root)"
_TYPES = ("BiologicalParent", "AssumedBiological", "UntypedParent", "StepParent", "AdoptiveParent", "FosterParent", "OtherParent")
_SUPPLY = f"""ed AS (SELECT l_partkey AS source, l_suppkey AS destination, ([{", ".join(repr(t) for t in _TYPES)}])[min(l_linenumber) % 7 + 1] AS type FROM lineitem GROUP BY 1, 2),
ve AS (SELECT p_partkey AS id, 'part' AS given_name, p_partkey::VARCHAR AS surname, p_partkey % 5 AS iteration FROM part)"""


# The algebra once more, written for the oracles by arithmetic and lists and apart from functions.algebra.


def _sum(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 OR {y} = 0 THEN {x} + {y} WHEN {x} < {y} THEN {x} ELSE {y} END)"


def _top(x: str) -> str:
    """The largest power of two up to ``x``."""
    return f"(1::BIGINT << floor(log2(greatest({x}, 1)::DOUBLE))::INT)"


def _times(x: str, y: str) -> str:
    return f"""(CASE WHEN {x} = 0 OR {y} = 0 OR (abs({x}) = 1 AND {x} + {y} = 0) THEN 0 WHEN abs({x}) = 1 THEN {y}
  WHEN abs({y}) = 1 THEN CASE WHEN ({x} & 1 = 1) = ({y} = 1) THEN {x} ELSE 0 END ELSE {x} * {_top(y)} + {y} - {_top(y)} END)"""


def _kin_name(a: str, b: str) -> str:
    n, g = f"least({a}, {b})", f"(greatest({a}, {b}) - least({a}, {b}))"
    cousin = f"coalesce((['0th', '1st', '2nd', '3rd'])[{n}], ({n} - 1)::VARCHAR || 'th') || ' cousin'"
    return f"""(CASE WHEN {n} > 0 AND {a} + {b} <= 3 THEN (['', 'sibling', 'aunt/uncle'])[{a} + {b}] WHEN {n} > 0 THEN {cousin} || CASE WHEN {g} > 0 THEN ' ' || {g}::VARCHAR || ' removed' ELSE '' END
  WHEN {g} BETWEEN 1 AND 5 THEN (['parent', 'grandparent', 'great grandparent', '2nd great grandparent', '3rd great grandparent'])[{g}] ELSE ({g} - 2)::VARCHAR || 'th great grandparent' END)"""


def _sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1] if len(parts) > 1 else parts[0]


def query(name: str, *oracle: str) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` are the pieces of its SQL, the last one the SELECT."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = _sql(*oracle)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _part(spark: SparkSession, d: str):
    return fixtures.part_graph(spark, d)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).matrix()


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Two relationship values for each order line."""
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        "l_orderkey", "cast(l_linenumber as bigint) as l_linenumber", "l_partkey", "l_suppkey", "l_partkey % 41 - 1 as x", "l_suppkey % 37 - 1 as y"
    )


_V = "l AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_partkey % 41 - 1 AS x, l_suppkey % 37 - 1 AS y FROM lineitem)"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# --- scalar algebra ---------------------------------------------------------


@query("avos_sum", _V, f"SELECT {_LINES}, x, y, {_sum('x', 'y')} AS s FROM l")
def avos_sum(spark, d):
    return _values(spark, d).select(*_LINE, "x", "y", A.avos_sum("x", "y").alias("s"))


@query("avos_product", _V, f"SELECT {_LINES}, x, y, {_times('x', 'y')} AS p FROM l")
def avos_product(spark, d):
    return _values(spark, d).select(*_LINE, "x", "y", A.avos_product("x", "y").alias("p"))


@query("generation_msb", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey * 99991 <= 1 THEN 0 ELSE floor(log2((l_orderkey * 99991)::DOUBLE))::BIGINT END AS g FROM lineitem")
def generation_msb(spark, d):
    big = _values(spark, d).withColumn("x", F.col("l_orderkey") * 99991)
    return big.select(*_LINE, A.msb("x").cast("long").alias("g"))


@query("avos_lt", _V, f"SELECT {_LINES}, CASE WHEN y = 0 THEN x <> 0 WHEN x = 0 THEN false ELSE x < y END AS less FROM l")
def avos_lt(spark, d):
    return _values(spark, d).select(*_LINE, F.expr(A.lt_sql("x", "y")).alias("less"))


@query(
    "avos_elementwise",
    f"""a AS (SELECT p_partkey AS k, p_partkey % 23 - 1 AS x, p_size::BIGINT % 19 - 1 AS y FROM part)
SELECT k, CASE WHEN x = 0 THEN y WHEN y = 0 THEN x ELSE least(x, y) END AS s, {_times('x', 'y')} AS p FROM a""".replace("a AS", "WITH a AS", 1),
)
def avos_elementwise(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    a = part.selectExpr("p_partkey as k", "p_partkey % 23 - 1 as x")
    b = part.selectExpr("p_partkey as k", "cast(p_size as bigint) % 19 - 1 as y")
    return a.join(b, "k").select("k", A.avos_sum("x", "y").alias("s"), A.avos_product("x", "y").alias("p"))


@query(
    "traversal_path",
    _PART, _close(),
    "SELECT i, j, v, CASE WHEN v <= 1 THEN '' ELSE list_aggregate(list_transform(range(length(bin(v)) - 1), lambda k: CASE WHEN (v >> (length(bin(v)) - 2 - k)) & 1 = 1 THEN 'b' ELSE 'r' END), 'string_agg', '') END AS path FROM cm",
)
def traversal_path(spark, d):
    return closed_matrix(spark, d).select("i", "j", "v", F.array_join(A.steps("v"), "").alias("path"))


@query(
    "decode_relationship",
    _PART, _close(),
    """SELECT i, j, CASE v WHEN -1 THEN 'RED_ONE (male identity)' WHEN 1 THEN 'BLACK_ONE (female identity)' ELSE
  CASE WHEN v % 2 = 1 THEN 'female ' ELSE 'male ' END || CASE WHEN v < 4 THEN 'parent' WHEN v < 8 THEN 'grandparent' WHEN v < 16 THEN 'great-grandparent'
  ELSE repeat('great-', floor(log2(v))::INT - 2) || 'grandparent' END END AS said FROM cm""",
)
def decode_relationship(spark, d):
    return closed_matrix(spark, d).select("i", "j", F.expr(A.describe_sql("v")).alias("said"))


@query("consanguinity_label", f"WITH l AS (SELECT DISTINCT l_partkey % 12 AS da, l_suppkey % 12 AS db FROM lineitem) SELECT da, db, {_kin_name('da', 'db')} AS said FROM l")
def consanguinity_label(spark, d):
    pairs = _values(spark, d).selectExpr("l_partkey % 12 as da", "l_suppkey % 12 as db").distinct()
    return pairs.select("da", "db", F.expr(A.consanguinity_sql("da", "db")).alias("said"))


@query("identity_predicates", "SELECT p_partkey AS k, p_partkey % 256 = 255 AS is_red, p_partkey % 256 = 1 AS is_black, CASE WHEN p_partkey % 256 = 255 THEN -1 ELSE p_partkey % 256 END AS v FROM part")
def identity_predicates(spark, d):
    k = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as k", "p_partkey % 256 as u")
    v = k.select("k", A.from_unsigned("u", 8).alias("v"))
    return v.select("k", (F.col("v") == A.RED).alias("is_red"), (F.col("v") == A.BLACK).alias("is_black"), "v")


@query(
    "algebra_laws",
    f"""WITH g AS (SELECT unnest(range(2, 34)) AS x), h AS (SELECT a.x, b.x AS y, c.x AS z FROM g a, g b, g c),
p AS (SELECT x, y, z, {_times('x', 'y')} AS xy, {_times('y', 'z')} AS yz, least(y, z) AS s, {_times('x', 'z')} AS xz FROM h)
SELECT count(*)::BIGINT AS triples, count(*) FILTER (WHERE {_times('xy', 'z')} = {_times('x', 'yz')})::BIGINT AS associative,
  count(*) FILTER (WHERE {_times('x', 's')} = least(xy, xz))::BIGINT AS distributive, count(*) FILTER (WHERE xy > x AND xy > y)::BIGINT AS growing FROM p""",
)
def algebra_laws(spark, d):
    g = spark.range(2, 34).withColumnRenamed("id", "x")
    h = g.crossJoin(g.withColumnRenamed("x", "y")).crossJoin(g.withColumnRenamed("x", "z"))
    p = h.select("x", "y", "z", A.avos_product("x", "y").alias("xy"), A.avos_product("y", "z").alias("yz"), A.avos_product("x", "z").alias("xz"), A.avos_sum("y", "z").alias("s"))
    count = lambda c: F.count_if(c)
    return p.agg(
        F.count("*").alias("triples"),
        count(A.avos_product("xy", "z") == A.avos_product("x", "yz")).alias("associative"),
        count(A.avos_product("x", "s") == A.avos_sum("xy", "xz")).alias("distributive"),
        count((F.col("xy") > F.col("x")) & (F.col("xy") > F.col("y"))).alias("growing"),
    )


# --- vectors and matrices ---------------------------------------------------

_U = "u AS (SELECT p_partkey AS k, 2 + p_partkey % 2 AS v FROM part)"
_W = "w AS (SELECT p_partkey AS k, 2 + p_partkey // 3 % 6 AS v FROM part)"


def _u(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as k", "2 + p_partkey % 2 as v")


def _w(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as k", "2 + p_partkey div 3 % 6 as v")


_XY = _times("a.v", "b.v")


@query("vec_avos", _U, _W, f"SELECT coalesce(min(nullif({_XY}, 0)), 0)::BIGINT AS v FROM u a JOIN w b USING (k)")
def vec_avos(spark, d):
    return linalg.dot(_u(spark, d), _w(spark, d))


@query("row_vector_product", _PART, _MATRIX, _U, f"SELECT b.j AS k, min(nullif({_XY}, 0)) AS v FROM u a JOIN m b ON a.k = b.i GROUP BY 1 HAVING min(nullif({_XY}, 0)) IS NOT NULL")
def row_vector_product(spark, d):
    return linalg.row_times(_u(spark, d), _matrix(spark, d))


@query("column_vector_product", _PART, _MATRIX, _W, f"SELECT a.i AS k, min(nullif({_XY}, 0)) AS v FROM m a JOIN w b ON a.j = b.k GROUP BY 1 HAVING min(nullif({_XY}, 0)) IS NOT NULL")
def column_vector_product(spark, d):
    return linalg.times_column(_matrix(spark, d), _w(spark, d))


_MM = f"SELECT a.i, b.j, min(nullif({_XY}, 0)) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2 HAVING min(nullif({_XY}, 0)) IS NOT NULL"


@query("matmul", _PART, _MATRIX, _MM)
def matmul(spark, d):
    m = _matrix(spark, d)
    return linalg.matmul(m, m)


@query("matmul_upper_triangular", _PART, _MATRIX, "n AS (SELECT j AS i, i AS j, v FROM m)", _MM.replace("m a JOIN m b", "n a JOIN n b").replace("GROUP BY", "WHERE b.j >= a.i GROUP BY"))
def matmul_upper_triangular(spark, d):
    m = linalg.transpose(_matrix(spark, d))
    return linalg.matmul(m, m, upper=True)


@query("product_pattern", _PART, _MATRIX, "p AS (SELECT DISTINCT a.i, b.j FROM m a JOIN m b ON a.j = b.i), n AS (SELECT i, count(*)::BIGINT AS cells FROM p GROUP BY i)", "SELECT i, cells, sum(cells) OVER (ORDER BY i)::BIGINT AS upto FROM n")
def product_pattern(spark, d):
    """Cells of each row of a product, and their running sum: sums of the range partitions before, then inside one."""
    m = _matrix(spark, d)
    rows = linalg.pattern(m, m).groupBy("i").agg(F.count("*").alias("cells"))
    ranked = structure.numbered(rows, [F.col("i")])
    block = ranked.withColumn("block", F.expr("n div 65536"))
    whole = block.groupBy("block").agg(F.sum("cells").alias("s"))
    from pyspark.sql import Window

    # One row a block of 65,536 rows.
    before = whole.withColumn("base", F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", F.coalesce("base", F.lit(0)).alias("base"))
    inside = F.sum("cells").over(Window.partitionBy("block").orderBy("i"))
    return block.join(before, "block").select("i", "cells", (F.col("base") + inside).alias("upto"))


@query("matmul_stats", _PART, _MATRIX, f"p AS ({_MM})", "SELECT (SELECT count(*) FROM m)::BIGINT AS left_nnz, (SELECT count(*) FROM p)::BIGINT AS nnz, round((SELECT count(*) FROM p)::DOUBLE / (SELECT count(*) FROM v) / (SELECT count(*) FROM v), 9) AS density")
def matmul_stats(spark, d):
    g = _part(spark, d)
    m = g.matrix()
    p = linalg.matmul(m, m).agg(F.count("*").alias("nnz"))
    sizes = m.agg(F.count("*").alias("left_nnz")).crossJoin(p).crossJoin(g.vertices.agg(F.count("*").alias("n")))
    return sizes.select("left_nnz", "nnz", F.round(F.col("nnz") / F.col("n") / F.col("n"), 9).alias("density"))


@query("einsum_trace", _PART, _MATRIX, "SELECT coalesce(min(v), 0)::BIGINT AS v FROM m WHERE i = j")
def einsum_trace(spark, d):
    return einsum("ii->", _matrix(spark, d))


@query("einsum_diag", _PART, _MATRIX, "SELECT i, v FROM m WHERE i = j")
def einsum_diag(spark, d):
    return einsum("ii->i", _matrix(spark, d))


@query("einsum_transpose", _PART, _MATRIX, "SELECT j, i, v FROM m")
def einsum_transpose(spark, d):
    return einsum("ij->ji", _matrix(spark, d))


@query("einsum_axis_sum", _PART, _MATRIX, "SELECT j, min(v) AS v FROM m GROUP BY j")
def einsum_axis_sum(spark, d):
    return einsum("ij->j", _matrix(spark, d))


@query("einsum_inner", _U, _W, f"SELECT coalesce(min(nullif({_XY}, 0)), 0)::BIGINT AS v FROM u a JOIN w b USING (k)")
def einsum_inner(spark, d):
    return einsum("i,i", _u(spark, d), _w(spark, d))


@query("einsum_matvec", _PART, _MATRIX, _W, f"SELECT a.i, min(nullif({_XY}, 0)) AS v FROM m a JOIN w b ON a.j = b.k GROUP BY 1 HAVING min(nullif({_XY}, 0)) IS NOT NULL")
def einsum_matvec(spark, d):
    return einsum("ij,j->i", _matrix(spark, d), _w(spark, d))


@query("einsum_matmul", _PART, _MATRIX, _MM.replace("a.i, b.j", "a.i AS i, b.j AS k"))
def einsum_matmul(spark, d):
    m = _matrix(spark, d)
    return einsum("ij,jk", m, m)


@query("einsum_outer", "WITH a AS (SELECT r_regionkey::BIGINT AS k, r_regionkey + 2 AS v FROM region), b AS (SELECT n_nationkey::BIGINT AS k, n_regionkey - 1 AS v FROM nation)"
       f" SELECT a.k AS i, b.k AS j, {_XY}::BIGINT AS v FROM a, b WHERE {_XY} <> 0")
def einsum_outer(spark, d):
    a = spark.read.parquet(f"{d}/region.parquet").selectExpr("cast(r_regionkey as bigint) k", "cast(r_regionkey + 2 as bigint) v")
    b = spark.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_nationkey as bigint) k", "cast(n_regionkey - 1 as bigint) v")
    return einsum("i,j->ij", a, b)


@query("einsum_chain", _PART, _MATRIX, f"p AS (SELECT a.i, b.j AS k, {_XY} AS v FROM m a JOIN m b ON a.j = b.i)", f"SELECT a.i, b.j AS l, min(nullif({_XY}, 0)) AS v FROM p a JOIN m b ON a.k = b.i WHERE a.v <> 0 GROUP BY 1, 2 HAVING v IS NOT NULL".replace(" HAVING v IS", " HAVING min(nullif(" + _XY + ", 0)) IS"))
def einsum_chain(spark, d):
    m = _matrix(spark, d)
    return einsum("ij,jk,kl->il", m, m, m)


@query("matrix_avos_sum", _PART, _MATRIX, f"p AS ({_MM})", "SELECT i, j, min(v) AS v FROM (SELECT * FROM m UNION ALL SELECT * FROM p) GROUP BY i, j")
def matrix_avos_sum(spark, d):
    m = _matrix(spark, d)
    return linalg.add(m, linalg.matmul(m, m))


@query("matrix_equal", _PART, _MATRIX, f"p AS ({_MM})", "SELECT m.i, m.j, m.v AS a, p.v AS b FROM m FULL JOIN p USING (i, j) WHERE m.v IS DISTINCT FROM p.v".replace("m.i, m.j", "i, j"))
def matrix_equal(spark, d):
    m = _matrix(spark, d)
    return linalg.differences(m, linalg.matmul(m, m))


@query("scalar_scale", _PART, _MATRIX, "SELECT i, j, v * 3 AS v FROM m")
def scalar_scale(spark, d):
    return linalg.scale(_matrix(spark, d), 3)


@query("cardinality", _PART, "SELECT count(*) FILTER (WHERE color = -1)::BIGINT AS red, count(*) FILTER (WHERE color = 1)::BIGINT AS black FROM v")
def cardinality(spark, d):
    return _matrix(spark, d).where("i = j").agg(F.count_if(F.col("v") == -1).alias("red"), F.count_if(F.col("v") == 1).alias("black"))


@query("offspring_composition", _PART, _close(), "p AS (SELECT j AS k, CASE WHEN v = -1 THEN 2 ELSE v + (1::BIGINT << (length(bin(v)) - 1)) END AS x FROM cm WHERE i = 100 UNION ALL SELECT j, CASE WHEN v = 1 THEN 3 ELSE v + 2 * (1::BIGINT << (length(bin(v)) - 1)) END FROM cm WHERE i = 101)", "SELECT k, min(x)::BIGINT AS v FROM p GROUP BY k")
def offspring_composition(spark, d):
    c = closed_matrix(spark, d)
    row = lambda i: c.where(F.col("i") == i).select(F.col("j").alias("k"), "v")
    return linalg.offspring(row(100), row(101))


@query("matrix_nnz", _PART, _MATRIX, "SELECT count(*)::BIGINT AS nnz, count(DISTINCT (i, j))::BIGINT AS distinct_cells FROM m")
def matrix_nnz(spark, d):
    return _matrix(spark, d).agg(linalg.nnz(None).alias("nnz"), F.count_distinct("i", "j").alias("distinct_cells"))


# --- closures ---------------------------------------------------------------

_PATHS = "SELECT i, j, v FROM c"


@query("transitive_closure", _PART, _close(), _PATHS)
def transitive_closure(spark, d):
    return C.transitive_closure(_part(spark, d).edges).paths


@query("closure_squaring", _PART, _close(), _PATHS)
def closure_squaring(spark, d):
    return C.squaring(_part(spark, d).edges).paths


@query("closure_dag", _PART7, _close(), _PATHS)
def closure_dag(spark, d):
    return C.semi_naive(fixtures.part7_graph(spark, d).edges).paths


@query("closure_levelwise", _CONV, _close(), _PATHS)
def closure_levelwise(spark, d):
    return C.levelwise(fixtures.conversation_graph(spark, d).edges).paths


@query("dag_levels", _CONV, "t AS (SELECT vertex_id, 0::BIGINT AS level FROM v UNION SELECT e.i, t.level + 1 FROM t JOIN e ON e.j = t.vertex_id)", "SELECT vertex_id, max(level) AS level FROM t GROUP BY 1")
def dag_levels(spark, d):
    g = fixtures.conversation_graph(spark, d)
    return C.levels(g.edges, g.vertices)


@query("closure_single_source", _PART, _close(), "SELECT i, j, v FROM c WHERE i = (SELECT max(vertex_id) FROM v)")
def closure_single_source(spark, d):
    g = _part(spark, d)
    return C.semi_naive(g.edges, g.vertices.agg(F.max("vertex_id").alias("i"))).paths


@query("closure_limited", _PART, _close(), "SELECT i, j, v FROM c WHERE v <= 7")
def closure_limited(spark, d):
    return C.semi_naive(_part(spark, d).edges, limit=7).paths


@query("closure_multi_source_min", _PART, _close(), "SELECT j, min(v) AS v FROM c WHERE i NOT IN (SELECT j FROM e) GROUP BY j")
def closure_multi_source_min(spark, d):
    """From all vertices that are nobody's parent."""
    g = _part(spark, d)
    childless = g.vertices.select(F.col("vertex_id").alias("i")).join(g.edges.select(F.col("j").alias("i")), "i", "left_anti")
    return C.multi_source_min(g.edges, childless)


@query("closure_component_wise", _PART7, _REACH, _close(), "SELECT comp.component, c.i, c.j, c.v FROM c JOIN comp ON comp.vertex_id = c.i")
def closure_component_wise(spark, d):
    g = fixtures.part7_graph(spark, d)
    return C.by_component(g.edges, g.vertices)[0].paths.withColumn("component", F.col("component").cast("long"))


@query("closure_adaptive", _CONV, _close(), _PATHS)
def closure_adaptive(spark, d):
    return C.transitive_closure(fixtures.conversation_graph(spark, d).edges, "no such strategy").paths


_HOPS = """t AS (SELECT i, j, 1::BIGINT AS d FROM e UNION SELECT t.i, e.j, t.d + 1 FROM t JOIN e ON t.j = e.i)"""


@query("shortest_path_hops", _PART, _HOPS, "SELECT i, j, min(d) AS d FROM t GROUP BY i, j")
def shortest_path_hops(spark, d):
    return C.weighted_paths(_part(spark, d).edges.withColumn("w", F.lit(1))).select("i", "j", "d")


@query("shortest_path_weighted", _PART, "w AS (SELECT i, j, 1 + (i * 7 + j * 3) % 11 AS w FROM e)", "t AS (SELECT i, j, w AS d FROM w UNION SELECT t.i, w.j, t.d + w.w FROM t JOIN w ON t.j = w.i)", "SELECT i, j, min(d) AS d FROM t GROUP BY i, j")
def shortest_path_weighted(spark, d):
    return C.weighted_paths(_part(spark, d).edges.withColumn("w", F.expr("1 + (i * 7 + j * 3) % 11"))).select("i", "j", "d")


@query("path_predecessors", _PART, _close(), "SELECT c.i, c.j, c.v, min(e.i) AS pred FROM c JOIN e ON e.j = c.j AND e.v % 2 = c.v % 2 LEFT JOIN c p ON p.i = c.i AND p.j = e.i WHERE (c.v <= 3 AND e.i = c.i) OR (c.v > 3 AND p.v = c.v >> 1) GROUP BY ALL")
def path_predecessors(spark, d):
    return C.predecessors(closure_of(spark, d), _part(spark, d).edges)


@query("dist_matrix", _PART, _close(), "SELECT i, j, (2 * (length(bin(v)) - 1) + bit_count(v) - 1)::BIGINT AS d FROM c")
def dist_matrix(spark, d):
    edges = _part(spark, d).edges
    paths = walk.paths(edges)
    return C.distance_matrix(closure_of(spark, d) if paths is None else paths, edges)


@query("shortest_path_methods", _PART, _close(), "h AS (SELECT i, j, v AS d FROM e UNION SELECT h.i, e.j, h.d + e.v FROM h JOIN e ON h.j = e.i)",
       "SELECT 'algebra' AS rule, i, j, v AS d FROM c UNION ALL SELECT 'plain', i, j, min(d) FROM h GROUP BY i, j")
def shortest_path_methods(spark, d):
    edges = _part(spark, d).edges
    paths = lambda method: C.shortest_path(edges, method).select("i", "j", "d")
    return paths("D").withColumn("rule", F.lit("algebra")).unionByName(paths("BF").withColumn("rule", F.lit("plain"))).select("rule", "i", "j", "d")


@query("path_vertices", _PART, "t AS (SELECT i, j, v, [i, j] AS path FROM e UNION SELECT t.i, n.j, t.v * 2 + (n.v - 2), list_append(t.path, n.j) FROM t JOIN e n ON t.j = n.i)", "k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY v) AS o FROM t)", "SELECT i, j, v, array_to_string(path, '>') AS path FROM k WHERE o = 1")
def path_vertices(spark, d):
    walked = C.path_vertices(_part(spark, d).edges, closure_of(spark, d))
    return walked.select("i", "j", "v", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("diameter", _PART, _close(), "SELECT max(length(bin(v)) - 1)::BIGINT AS diameter FROM c")
def diameter(spark, d):
    return closure_of(spark, d).agg(F.max(A.msb("v")).cast("long").alias("diameter"))


_REFUSE = [name for name in C.STRATEGIES if name != "auto"]


@query(
    "cycle_detect",
    _CYC,
    "r AS (SELECT i AS a, j AS b FROM e WHERE i = 2 UNION SELECT r.a, e.j FROM r JOIN e ON e.i = r.b)",
    f"SELECT s.name AS strategy, CASE WHEN bool_or(r.a = r.b) THEN 'Error: cycle detected!' ELSE '' END AS said, bool_or(r.a = r.b) AS on_cycle FROM r, (SELECT unnest({_REFUSE}) AS name) s GROUP BY s.name",
)
def cycle_detect(spark, d):
    """Every strategy refuses the cyclic graph; the vertex it names lies on a cycle."""
    edges = fixtures.cyclic_graph(spark, d).edges
    said, vertices = [], {}
    for name in _REFUSE:
        try:
            C.transitive_closure(edges, name)
            said.append((name, "", False))
        except CycleError as error:
            if error.vertex not in vertices:
                vertices[error.vertex] = quality.shortest_cycle(edges, error.vertex) is not None
            said.append((name, str(error), vertices[error.vertex]))
    return spark.createDataFrame(said, "strategy string, said string, on_cycle boolean")


# --- incremental maintenance ------------------------------------------------


@query("vertex_composition", _PART.replace("e AS (", "e0 AS ("), "e AS (SELECT * FROM e0 UNION ALL SELECT 10000000, 100, 2 UNION ALL SELECT 10000000, 101, 3 UNION ALL SELECT 150, 10000000, 3)", _close(), "SELECT i, j, v FROM cm UNION ALL SELECT 10000000, 10000000, 1")
def vertex_composition(spark, d):
    row = spark.createDataFrame([(100, 2), (101, 3)], "k long, v long")
    column = spark.createDataFrame([(150, 3)], "k long, v long")
    return compose.add_vertex(closed_matrix(spark, d), row, column, 10_000_000, 1)


@query("edge_composition", _PART.replace("e AS (", "e0 AS ("), "e AS (SELECT * FROM e0 UNION ALL SELECT 150, 120, 2)", _close(), "SELECT i, j, v FROM cm")
def edge_composition(spark, d):
    return compose.add_edge(closed_matrix(spark, d), 150, 120, 2)


@query("composition_cycle_guard", _PART, _close(), "SELECT b.vertex_id AS alpha, c.i AS beta FROM v b JOIN c ON c.i = b.vertex_id + 37 AND c.j = b.vertex_id % 11")
def composition_cycle_guard(spark, d):
    """Edges asked for, from k % 11 of each part k to k + 37, that would close a cycle."""
    asked = _part(spark, d).vertices.selectExpr("vertex_id as alpha", "vertex_id % 11 as target", "vertex_id + 37 as beta")
    back = closure_of(spark, d).select(F.col("i").alias("beta"), F.col("j").alias("target"))
    return asked.join(back, ["beta", "target"], "left_semi").select("alpha", "beta")


# --- kinship ----------------------------------------------------------------

_PAIRS = "q AS (SELECT vertex_id AS a, (vertex_id * 7 + 13) % (SELECT count(*) FROM v) AS b FROM v)"


def _pairs(spark, d):
    v = _part(spark, d).vertices
    n = v.agg(F.count("*").alias("n"))
    return v.crossJoin(F.broadcast(n)).selectExpr("vertex_id as a", "(vertex_id * 7 + 13) % n as b")


@query(
    "kinship_pairs",
    _PART, _close(), _PAIRS,
    "k AS (SELECT q.a, q.b, x.j, x.v AS x, y.v AS y, row_number() OVER (PARTITION BY q.a, q.b ORDER BY x.v + y.v, x.j) AS o FROM q JOIN cm x ON x.i = q.a JOIN cm y ON y.i = q.b AND y.j = x.j)",
    f"z AS (SELECT q.a, q.b, k.j, floor(log2(greatest(k.x, 1)::DOUBLE))::BIGINT AS da, floor(log2(greatest(k.y, 1)::DOUBLE))::BIGINT AS db FROM q LEFT JOIN k ON k.a = q.a AND k.b = q.b AND k.o = 1)",
    f"SELECT a, b, coalesce(j, -1) AS common_ancestor, CASE WHEN j IS NULL THEN 'No Relationship' ELSE {_kin_name('da', 'db')} END AS relationship FROM z",
)
def kinship_pairs(spark, d):
    return kinship.kinship(closed_matrix(spark, d), _pairs(spark, d))


@query("ancestors_of", _PART, _close(), "SELECT j AS vertex_id, v FROM c WHERE i = 199")
def ancestors_of(spark, d):
    return kinship.ancestors(closure_of(spark, d), 199)


@query("descendants_of", _PART, _close(), "SELECT i AS vertex_id, v FROM c WHERE j = 7")
def descendants_of(spark, d):
    return kinship.descendants(closure_of(spark, d), 7)


@query("is_ancestor", _PART, _close(), "SELECT v.vertex_id AS a, v.vertex_id % 17 AS b FROM v WHERE EXISTS (SELECT 1 FROM c WHERE c.i = v.vertex_id AND c.j = v.vertex_id % 17)")
def is_ancestor(spark, d):
    asked = _part(spark, d).vertices.selectExpr("vertex_id as a", "vertex_id % 17 as b")
    return kinship.are_ancestors(closure_of(spark, d), asked).select("a", "b")


@query("sibling_pairs", _PART, "SELECT x.i AS a, y.i AS b, count(*)::BIGINT AS shared FROM e x JOIN e y ON x.j = y.j AND x.i < y.i GROUP BY 1, 2")
def sibling_pairs(spark, d):
    return kinship.siblings(_part(spark, d).edges)


@query("consanguinity_check", _PART, _close(), _PAIRS, "n AS (SELECT i, j FROM c WHERE v < 16 UNION SELECT vertex_id, vertex_id FROM v)", "SELECT DISTINCT q.a, q.b FROM q JOIN n x ON x.i = q.a JOIN n y ON y.i = q.b AND y.j = x.j WHERE q.a <> q.b")
def consanguinity_check(spark, d):
    return kinship.related_within(closure_of(spark, d), _pairs(spark, d).where("a <> b"), 3)


# --- structure --------------------------------------------------------------


def _labels(spark, d):
    g = fixtures.part7_graph(spark, d)
    return structure.connected_components(g.edges, g.vertices).select("vertex_id", F.col("component").cast("long").alias("component"))


@query("connected_components", _PART7, _REACH, "SELECT vertex_id, component FROM comp")
def connected_components(spark, d):
    return _labels(spark, d)


@query("component_sizes", _PART7, _REACH, "SELECT component, count(*)::BIGINT AS size FROM comp GROUP BY 1")
def component_sizes(spark, d):
    return structure.component_sizes(_labels(spark, d))


@query("component_vertices", _CONV, _REACH, "SELECT component, string_agg(vertex_id::VARCHAR, ',' ORDER BY vertex_id) AS vertices FROM comp GROUP BY 1")
def component_vertices(spark, d):
    g = fixtures.conversation_graph(spark, d)
    found = structure.component_vertices(structure.connected_components(g.edges, g.vertices))
    return found.select("component", F.array_join(F.transform("vertices", lambda x: x.cast("string")), ",").alias("vertices"))


@query("extract_submatrix", _PART, _MATRIX, "s AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS n FROM v WHERE vertex_id % 3 = 0)", "SELECT a.n AS i, b.n AS j, m.v FROM m JOIN s a ON a.vertex_id = m.i JOIN s b ON b.vertex_id = m.j")
def extract_submatrix(spark, d):
    g = _part(spark, d)
    return structure.submatrix(g.matrix(), g.vertices.where("vertex_id % 3 = 0"))[0]


@query("merge_components", _PART, _MATRIX, "SELECT i, j, v FROM m WHERE i % 2 = j % 2")
def merge_components(spark, d):
    g = _part(spark, d)
    return structure.merge_components([structure.submatrix(g.matrix(), g.vertices.where(f"vertex_id % 2 = {r}")) for r in (0, 1)])


_TOPO = "o AS (SELECT v.vertex_id AS old, row_number() OVER (ORDER BY coalesce(n, 0) DESC, v.vertex_id) - 1 AS new FROM v LEFT JOIN (SELECT i, count(*) AS n FROM c GROUP BY i) x ON x.i = v.vertex_id)"
_RELABELLED = "SELECT a.new AS i, b.new AS j, {m}.v FROM {m} JOIN o a ON a.old = {m}.i JOIN o b ON b.old = {m}.j"


@query("topological_sort", _PART, _close(), _TOPO, "SELECT old, new FROM o")
def topological_sort(spark, d):
    return structure.topological_order(closure_of(spark, d), _part(spark, d).vertices)


@query("topological_ordering", _PART, _MATRIX, _close(), _TOPO, _RELABELLED.format(m="m"))
def topological_ordering(spark, d):
    g = _part(spark, d)
    return structure.topological_ordering(g.matrix(), closure_of(spark, d), g.vertices).matrix


_CANON = f"""o AS (SELECT v.vertex_id AS old, row_number() OVER (ORDER BY s.size DESC, comp.component, coalesce(r1.g, 0) DESC, coalesce(c1.x, 0), v.color DESC, v.vertex_id) - 1 AS new
  FROM v JOIN comp ON comp.vertex_id = v.vertex_id JOIN (SELECT component, count(*) AS size FROM comp GROUP BY 1) s ON s.component = comp.component
  LEFT JOIN (SELECT i, sum(floor(log2(greatest(v, 1)::DOUBLE))::BIGINT) AS g FROM cm GROUP BY i) r1 ON r1.i = v.vertex_id
  LEFT JOIN (SELECT j, greatest(max(v), 0) AS x FROM cm GROUP BY j) c1 ON c1.j = v.vertex_id)"""


@query("canonical_ordering", _PART7, _REACH, _close(), _CANON, "SELECT old, new FROM o")
def canonical_ordering(spark, d):
    g = fixtures.part7_graph(spark, d)
    return structure.canonical_ordering(closed_matrix(spark, d, "part7_graph"), g.vertices).permutation


@query("canonical_matrix", _PART7, _REACH, _close(), _CANON, _RELABELLED.format(m="cm"))
def canonical_matrix(spark, d):
    g = fixtures.part7_graph(spark, d)
    return structure.canonical_ordering(closed_matrix(spark, d, "part7_graph"), g.vertices).matrix


def _reversed(spark, d):
    v = _part(spark, d).vertices
    return v.crossJoin(F.broadcast(v.agg(F.max("vertex_id").alias("top")))).selectExpr("vertex_id as old", "top - vertex_id as new")


_BACKWARDS = "o AS (SELECT vertex_id AS old, (SELECT max(vertex_id) FROM v) - vertex_id AS new FROM v)"


@query("permute", _PART, _MATRIX, _BACKWARDS, _RELABELLED.format(m="m"))
def permute(spark, d):
    return structure.permute(_matrix(spark, d), _reversed(spark, d))


@query("permute_upper", _PART, _MATRIX, "o AS (SELECT vertex_id AS old, (vertex_id + 5) % (SELECT count(*) FROM v) AS new FROM v)", _RELABELLED.format(m="m") + " WHERE b.new >= a.new")
def permute_upper(spark, d):
    v = _part(spark, d).vertices
    turned = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).selectExpr("vertex_id as old", "(vertex_id + 5) % n as new")
    return structure.permute(_matrix(spark, d), turned, upper=True)


@query("is_upper_triangular", _PART, _MATRIX, "SELECT min((i <= j)::INT) = 1 AS as_it_is, min((j <= i)::INT) = 1 AS turned, min((j < i)::INT) = 1 AS strictly, max((j > i)::INT) = 0 AS lower FROM m")
def is_upper_triangular(spark, d):
    m = _matrix(spark, d)
    turned = linalg.transpose(m)
    a = m.agg(structure.is_upper_triangular(m).alias("as_it_is"), structure.is_lower_triangular(m).alias("lower"))
    return a.crossJoin(turned.agg(structure.is_upper_triangular(turned).alias("turned"), structure.is_upper_triangular(turned, strict=True).alias("strictly")))


@query("transpose", _PART, _MATRIX, "SELECT j AS i, i AS j, v FROM m")
def transpose(spark, d):
    return linalg.transpose(_matrix(spark, d))


@query("degrees", _PART, "SELECT vertex_id, (SELECT count(*) FROM e WHERE e.i = vertex_id)::BIGINT AS out_degree, (SELECT count(*) FROM e WHERE e.j = vertex_id)::BIGINT AS in_degree FROM v")
def degrees(spark, d):
    g = _part(spark, d)
    return structure.degrees(g.edges, g.vertices)


@query("validate_graph", _CYC, "p AS (SELECT e.i, e.j, e.v, v.color FROM e LEFT JOIN v ON v.vertex_id = e.j)",
       "SELECT 'parent_order' AS rule, i, j FROM e WHERE j >= i UNION ALL SELECT 'parent_color', i, j FROM p WHERE (v = 2 AND color <> -1) OR (v = 3 AND color <> 1) UNION ALL SELECT 'unknown_parent', i, j FROM p WHERE color IS NULL UNION ALL SELECT 'parents_of_one_color', i, min(j) FROM e GROUP BY i, v HAVING count(*) > 1")
def validate_graph(spark, d):
    return violations(fixtures.cyclic_graph(spark, d), ordered=True)


@query("from_dense", "SELECT l_orderkey * 8 + l_linenumber AS i, u.j, u.v FROM lineitem, LATERAL (VALUES (0::BIGINT, l_partkey), (1::BIGINT, l_suppkey), (2::BIGINT, l_quantity::BIGINT)) AS u(j, v) WHERE u.v <> 0")
def from_dense(spark, d):
    wide = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber as r", "l_partkey", "l_suppkey", "l_quantity")
    return wide_to_cells(wide, "r", {"l_partkey": 0, "l_suppkey": 1, "l_quantity": 2})


@query("to_dense", "SELECT n_regionkey::BIGINT AS i, " + ", ".join(f"coalesce(max(CASE WHEN n_nationkey = {k} THEN 2 + n_nationkey % 2 END), 0)::BIGINT AS c{k}" for k in range(25)) + " FROM nation GROUP BY 1")
def to_dense(spark, d):
    cells = spark.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_regionkey as bigint) i", "cast(n_nationkey as bigint) j", "cast(2 + n_nationkey % 2 as bigint) v")
    return cells_to_wide(cells, 25)


@query("density", _PART, _MATRIX, "SELECT round((SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM v) / (SELECT count(*) FROM v), 9) AS density")
def density(spark, d):
    g = _part(spark, d)
    sizes = g.matrix().agg(F.count("*").alias("m")).crossJoin(g.vertices.agg(F.count("*").alias("n")))
    return sizes.select(F.round(F.col("m") / F.col("n") / F.col("n"), 9).alias("density"))


@query("identity_matrix", _PART, "SELECT vertex_id AS i, vertex_id AS j, color AS v FROM v")
def identity_matrix(spark, d):
    return structure.identity(_part(spark, d).vertices)


@query("density_report", _PART, _MATRIX, _close(), "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "SELECT 'edges' AS operation, (SELECT count(*) FROM e)::BIGINT AS nnz, round((SELECT count(*) FROM e) / n / n, 9) AS density FROM n UNION ALL SELECT 'closure', (SELECT count(*) FROM cm)::BIGINT, round((SELECT count(*) FROM cm) / n / n, 9) FROM n")
def density_report(spark, d):
    g = _part(spark, d)
    monitor = structure.DensityMonitor(most=1.0)
    n = g.vertices.count()
    monitor.check(g.edges, n, "edges")
    monitor.check(closed_matrix(spark, d), n, "closure")
    return spark.createDataFrame([(r.operation, r.nnz, round(r.density, 9)) for r in monitor.history], "operation string, nnz long, density double")


@query("memory_estimate", _PART, _MATRIX, "SELECT (SELECT count(*) FROM v)::BIGINT * (SELECT count(*) FROM v) * 8 AS dense, (SELECT count(*) FROM m)::BIGINT * 16 + ((SELECT count(*) FROM v) + 1) * 8 AS compressed, (SELECT count(*) FROM m)::BIGINT * 24 AS row_bytes")
def memory_estimate(spark, d):
    g = _part(spark, d)
    bytes_ = structure.memory_estimate(g.vertices.count(), g.matrix().count())
    return spark.createDataFrame([(bytes_["dense"], bytes_["compressed"], bytes_["rows"])], "dense long, compressed long, row_bytes long")


def _moments(of: str) -> str:
    return f"""SELECT count(*)::BIGINT AS n, max(x)::BIGINT AS largest, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance,
  round(avg((x - mu) ** 3) / var_pop(x) ** 1.5, 6) AS skewness, round(avg((x - mu) ** 4) / var_pop(x) ** 2 - 3, 6) AS kurtosis FROM (SELECT x::DOUBLE AS x, avg(x) OVER () AS mu FROM ({of}))"""


def _rounded(df):
    return df.select("n", "largest", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "skewness", "kurtosis")])


def _count_cells(side: str) -> str:
    return _moments(f"SELECT (SELECT count(*) FROM cm WHERE cm.{side} = v.vertex_id) AS x FROM v")


@query("closure_row_stats", _PART, _close(), _count_cells("i"))
def closure_row_stats(spark, d):
    return _rounded(structure.described(structure.cells_per(closed_matrix(spark, d), _part(spark, d).vertices, "i"), "cells"))


@query("closure_col_stats", _PART, _close(), _count_cells("j"))
def closure_col_stats(spark, d):
    return _rounded(structure.described(structure.cells_per(closed_matrix(spark, d), _part(spark, d).vertices, "j"), "cells"))


@query("component_stats", _PART7, _REACH, _moments("SELECT count(*) AS x FROM comp GROUP BY component"))
def component_stats(spark, d):
    return _rounded(structure.described(structure.component_sizes(_labels(spark, d)), "size"))


# --- data quality and cycles ------------------------------------------------


def _supply(spark, d) -> tuple[DataFrame, DataFrame]:
    kinds = F.array(*[F.lit(t) for t in _TYPES])
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("destination")).agg(F.min("l_linenumber").alias("n"))
    edges = lines.select("source", "destination", F.get(kinds, F.col("n") % 7).alias("type"))
    vertices = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", "'part' as given_name", "cast(p_partkey as string) as surname", "p_partkey % 5 as iteration")
    return vertices, edges


@query("edge_type_distribution", _SUPPLY, "SELECT type, count(*)::BIGINT AS n FROM ed GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*)::BIGINT FROM ed")
def edge_type_distribution(spark, d):
    return quality.type_distribution(_supply(spark, d)[1])


_NAME = "{0}.given_name || ' ' || {0}.surname"


@query("self_loops", _SUPPLY, f"SELECT ve.id, {_NAME.format('ve')} AS name, ed.type FROM ed JOIN ve ON ve.id = ed.source WHERE ed.source = ed.destination ORDER BY 1, 3 LIMIT 20")
def self_loops(spark, d):
    v, e = _supply(spark, d)
    return quality.self_loops(e, v)


@query("mutual_edges", _SUPPLY, "SELECT a.source, a.destination, a.type FROM ed a WHERE EXISTS (SELECT 1 FROM ed b WHERE b.source = a.destination AND b.destination = a.source)")
def mutual_edges(spark, d):
    return quality.mutual_edges(_supply(spark, d)[1])


@query("high_degree_vertices", _SUPPLY, f"SELECT ve.id, {_NAME.format('ve')} AS name, count(*)::BIGINT AS children FROM ed JOIN ve ON ve.id = ed.destination WHERE type IN ('BiologicalParent', 'AssumedBiological', 'UntypedParent') GROUP BY 1, 2 HAVING count(*) > 20 ORDER BY 3 DESC, 1 LIMIT 10")
def high_degree_vertices(spark, d):
    v, e = _supply(spark, d)
    return quality.high_degree(e, v)


@query("nonbio_edges", _SUPPLY, f"SELECT ve.id, {_NAME.format('ve')} AS name, type, count(*)::BIGINT AS n FROM ed JOIN ve ON ve.id = ed.source WHERE type IN ('StepParent', 'FosterParent', 'GuardianParent', 'AdoptiveParent') GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 3 LIMIT 20")
def nonbio_edges(spark, d):
    v, e = _supply(spark, d)
    return quality.nonbio_edges(e, v)


@query("mutual_exclusions", _SUPPLY, """p AS (SELECT a.source AS s, a.destination AS t, x.iteration AS h1, y.iteration AS h2 FROM ed a JOIN ed b ON b.source = a.destination AND b.destination = a.source JOIN ve x ON x.id = a.source JOIN ve y ON y.id = a.destination WHERE a.source < a.destination)""",
       "SELECT CASE WHEN h1 >= h2 THEN s ELSE t END AS from_id, CASE WHEN h1 >= h2 THEN t ELSE s END AS to_id, CASE WHEN h1 = h2 THEN 'same hop' ELSE 'inward edge' END AS reason FROM p")
def mutual_exclusions(spark, d):
    v, e = _supply(spark, d)
    return quality.mutual_exclusions(e, v)


@query("edges_of_types", _SUPPLY, f"SELECT source, {_NAME.format('a')} AS source_name, destination, {_NAME.format('b')} AS destination_name, type FROM ed JOIN ve a ON a.id = source JOIN ve b ON b.id = destination WHERE type IN ('StepParent', 'AdoptiveParent')")
def edges_of_types(spark, d):
    v, e = _supply(spark, d)
    return quality.edges_of_types(e, v, ["StepParent", "AdoptiveParent"])


@query("apply_exclusions", _PART, _MATRIX, "SELECT i, j, v FROM m WHERE i = j OR NOT ((i % 9 = 0 AND v = 2) OR i % 10 = 4 OR j % 10 = 4)")
def apply_exclusions(spark, d):
    g = _part(spark, d)
    return quality.apply_exclusions(g.matrix(), g.edges.where("i % 9 = 0 and v = 2").select("i", "j"), g.vertices.where("vertex_id % 10 = 4"))


@query("find_cycle_path", _CYC, "w AS (SELECT 2::BIGINT AS spot, [2::BIGINT] AS path UNION ALL SELECT e.j, list_append(w.path, e.j) FROM w JOIN e ON e.i = w.spot WHERE len(w.path) < 12 AND (len(w.path) = 1 OR w.spot <> 2))", "SELECT array_to_string(path, '>') AS path FROM w WHERE spot = 2 AND len(path) > 1 ORDER BY len(path), w.path LIMIT 1")
def find_cycle_path(spark, d):
    path = quality.shortest_cycle(fixtures.cyclic_graph(spark, d).edges, 2)
    return spark.createDataFrame([(">".join(map(str, path)),)] if path else [], "path string")


_CYCLES = "w AS (SELECT i AS start, j AS spot, [i] AS path FROM e WHERE j >= i UNION ALL SELECT w.start, e.j, list_append(w.path, w.spot) FROM w JOIN e ON e.i = w.spot WHERE len(w.path) < 8 AND w.spot <> w.start AND e.j >= w.start AND (e.j = w.start OR NOT list_contains(w.path, e.j)))"


@query("enumerate_cycles", _CYC, _CYCLES, "SELECT DISTINCT array_to_string(path, '>') AS cycle FROM w WHERE spot = start")
def enumerate_cycles(spark, d):
    found = quality.simple_cycles(fixtures.cyclic_graph(spark, d).edges)
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


_SCORE = "CASE type " + " ".join(f"WHEN '{k}' THEN {s}" for k, s in quality.RELIABILITY.items()) + f" ELSE {quality.OTHER_RELIABILITY} END"


@query("edge_reliability", _SUPPLY, f"SELECT p_partkey AS source, s.s_suppkey AS destination, type, CASE WHEN type IS NULL THEN 0 ELSE {_SCORE} END::BIGINT AS score FROM part JOIN supplier s ON s.s_suppkey = p_partkey % 50 LEFT JOIN ed ON ed.source = p_partkey AND ed.destination = s.s_suppkey")
def edge_reliability(spark, d):
    asked = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as source", "p_partkey % 50 as destination")
    there = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("destination"))
    return quality.edge_reliability(asked.join(there, "destination").select("source", "destination"), _supply(spark, d)[1])


@query("break_cycles_weakest", _CYC, _CYCLES, "y AS (SELECT DISTINCT path FROM w WHERE spot = start)",
       "l AS (SELECT path, k, path[k + 1] AS s, path[(k + 1) % len(path) + 1] AS t FROM y, LATERAL (SELECT unnest(range(len(path))) AS k))",
       "z AS (SELECT l.*, row_number() OVER (PARTITION BY path ORDER BY (s * 3 + t) % 17, k) AS o FROM l)",
       "SELECT DISTINCT s AS source, t AS destination FROM z WHERE o = 1")
def break_cycles_weakest(spark, d):
    e = fixtures.cyclic_graph(spark, d).edges
    scored = e.selectExpr("i as source", "j as destination", "(i * 3 + j) % 17 as score")
    return quality.weakest_links(quality.simple_cycles(e), scored).select("source", "destination").distinct()


@query("relationship_types", _SUPPLY, "SELECT p_partkey AS source, p_partkey % 50 AS destination, coalesce(type, 'Unknown') AS type FROM part LEFT JOIN ed ON ed.source = p_partkey AND ed.destination = p_partkey % 50")
def relationship_types(spark, d):
    asked = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as source", "p_partkey % 50 as destination")
    return quality.relationship_types(asked, _supply(spark, d)[1])


@query("cycle_participants", _CYC, "r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)", "SELECT i AS vertex_id FROM r WHERE i = j")
def cycle_participants(spark, d):
    return quality.cycle_participants(fixtures.cyclic_graph(spark, d).edges)


@query("typed_key_chain",
       "e AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1)",
       "SELECT n.n_regionkey::BIGINT AS region, sum(e.n)::BIGINT AS orders, count(*)::BIGINT AS customers FROM e JOIN customer ON c_custkey = e.c JOIN nation n ON n.n_nationkey = c_nationkey GROUP BY 1")
def typed_key_chain(spark, d):
    """Descendants of each region along the foreign keys: a closure limited to three generations, by kind of vertex."""
    _, edges = fixtures.key_edges(spark, d)
    typed = edges.where("type <> 'StepParent'").selectExpr("source as i", "destination as j", "case when destination < 1000 then 3L else 2L end as v")
    ends = fixtures.key_edges(spark, d)[0].where("given_name = 'region'").select(F.col("id").alias("j"))
    paths = C.semi_naive(typed, ends, reverse=True).paths
    kind = lambda lo, hi: F.count_if((F.col("i") >= lo) & (F.col("i") < hi))
    o = fixtures.OFFSETS
    orders = kind(o["orders"], 1 << 62).alias("orders")
    with_orders = edges.where(F.col("source") >= o["orders"]).select(F.col("destination").alias("i")).distinct().withColumn("buys", F.lit(1))
    customers = F.count_if((F.col("i") >= o["customer"]) & (F.col("i") < o["supplier"]) & F.col("buys").isNotNull()).alias("customers")
    return paths.join(with_orders, "i", "left").groupBy(F.col("j").alias("region")).agg(orders, customers)


@query("undirected_hops", _CONV, "n AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e)", "t AS (SELECT i, j, 1::BIGINT AS d FROM n UNION SELECT t.i, n.j, t.d + 1 FROM t JOIN n ON t.j = n.i WHERE t.d < 8)", "SELECT i, j, min(d) AS d FROM t WHERE i <> j GROUP BY i, j")
def undirected_hops(spark, d):
    g = fixtures.conversation_graph(spark, d)
    return C.weighted_paths(g.edges.withColumn("w", F.lit(1)), directed=False).select("i", "j", "d")


@query("relationship_files", _PART, "SELECT i::VARCHAR AS child, j::VARCHAR AS parent, v FROM e WHERE i % 7 <> 5")
def relationship_files(spark, d):
    """The part graph written as relationship files and read again, with an ignore list."""
    g = _part(spark, d)
    at = Scratch(spark, "files").root
    g.vertices.select("vertex_id", "color", F.concat(F.lit("Part, "), F.col("vertex_id")), F.lit(0)).write.csv(f"{at}/v")
    g.edges.select("i", "j", F.when(F.col("v") == 2, "Bio").otherwise("Step")).write.csv(f"{at}/e")
    g.edges.where("i % 7 = 5").select("i", "j").write.csv(f"{at}/ignore")
    read, _ = files.read_relationships(spark, f"{at}/v", f"{at}/e", ["Bio", "Step"], 4, ignore=f"{at}/ignore")
    name = lambda c, to: read.vertices.select(F.col("vertex_id").alias(c), F.col("external_id").alias(to))
    return read.edges.join(name("i", "child"), "i").join(name("j", "parent"), "j").select("child", "parent", "v")


@query("graph_cache", _PART, _MATRIX, "SELECT i, j, v FROM m")
def graph_cache(spark, d):
    """The part graph saved with its metadata and loaded from there."""
    at, about = Scratch(spark, "cache").root, {"source": d.rstrip("/").rsplit("/", 1)[-1]}
    files.save_graph(_part(spark, d), at, about)
    if not files.cache_valid(spark, at, about):
        raise ValueError("the cache just written is not valid")
    return files.load_graph(spark, at).matrix()


@query("absorbed_edges", _PART, _close(), _PATHS)
def absorbed_edges(spark, d):
    """The closure of two thirds of the edges, with the rest absorbed as a stream's batch would be."""
    e = _part(spark, d).edges
    return absorb(C.semi_naive(e.where("i % 3 <> 1")).paths, e.where("i % 3 = 1"))


@query("synthesize_family")
def synthesize_family(spark, d):
    """A seeded family as large as the table of customers: no SQL can make it; tests hold it against its rules."""
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    made = synth.synthesize(spark, synth.SynthesizerConfig(max(20, n // 10), num_generations=3, seed=42, pct_immigration_per_gen=10))
    return made.individuals
