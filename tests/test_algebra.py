import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import algebra as A

from . import model as M


def test_sum_product_and_order_over_a_grid(spark):
    grid = spark.range(-1, 40).withColumnRenamed("id", "x").crossJoin(spark.range(-1, 40).withColumnRenamed("id", "y"))
    rows = grid.select("x", "y", A.avos_sum("x", "y").alias("s"), A.avos_product("x", "y").alias("p"), F.expr(A.lt_sql("x", "y")).alias("lt")).collect()
    assert len(rows) == 41 * 41
    for r in rows:
        assert r["s"] == M.plus(r["x"], r["y"])
        assert r["p"] == M.times(r["x"], r["y"])
        assert r["lt"] == (r["x"] != 0 if r["y"] == 0 else r["x"] != 0 and r["x"] < r["y"])


def test_msb_is_exact_up_to_63_bits(spark):
    values = sorted({v for k in range(1, 63) for v in ((1 << k) - 1, 1 << k, (1 << k) + 1)} | {-1, 0, 1, (1 << 63) - 1})
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", A.msb("x").alias("g"))
    assert all(r["g"] == M.msb(r["x"]) for r in df.collect())


@pytest.mark.parametrize(("x", "y"), [(1 << 32, 1 << 32), ((1 << 63) - 1, 3), ((1 << 62) + 5, 2)])
def test_paths_that_do_not_fit_raise(spark, x, y):
    with pytest.raises(Exception, match="63 bits"):
        spark.createDataFrame([(x, y)], "x long, y long").select(A.avos_product("x", "y")).collect()


def test_values_below_minus_one_raise(spark):
    with pytest.raises(Exception, match="below -1"):
        spark.createDataFrame([(-2, 3)], "x long, y long").select(A.avos_product("x", "y")).collect()


def test_identities_do_not_associate(spark):
    row = spark.range(1).selectExpr("2L as a", "1L as b", "3L as c").withColumn("ab", A.avos_product("a", "b")).withColumn("bc", A.avos_product("b", "c"))
    got = row.select(A.avos_product("ab", "c").alias("l"), A.avos_product("a", "bc").alias("r")).first()
    assert (got["l"], got["r"]) == (0, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 1 << 18), min_size=3, max_size=3))
def test_model_laws_for_proper_paths(v):
    x, y, z = v
    assert M.times(M.times(x, y), z) == M.times(x, M.times(y, z))
    assert M.times(x, M.plus(y, z)) == M.plus(M.times(x, y), M.times(x, z))
    assert M.times(M.plus(x, y), z) == M.plus(M.times(x, z), M.times(y, z))


def test_steps_and_descriptions(spark):
    df = spark.range(-1, 40).select(F.col("id"), A.steps("id").alias("p"), F.expr(A.describe_sql("id")).alias("d"))
    got = {r["id"]: (r["p"], r["d"]) for r in df.collect()}
    for v in range(2, 40):
        assert got[v][0] == ["b" if b == "1" else "r" for b in bin(v)[3:]]
    assert got[1][0] == [] and got[0][0] == []
    assert got[2][1] == "male parent" and got[5][1] == "female grandparent" and got[9][1] == "female great-grandparent"
    assert got[34][1] == "male great-great-great-grandparent"
    assert got[-1][1].startswith("RED_ONE") and got[1][1].startswith("BLACK_ONE") and got[0][1] == "NULL"


# Distances to the common ancestor and the names they have.
KINDS = [
    (0, 1, "parent"), (0, 2, "grandparent"), (0, 3, "great grandparent"), (0, 4, "2nd great grandparent"), (0, 5, "3rd great grandparent"),
    (0, 6, "4th great grandparent"), (1, 1, "sibling"), (2, 1, "aunt/uncle"), (2, 2, "1st cousin"), (3, 3, "2nd cousin"), (4, 4, "3rd cousin"),
    (5, 5, "4th cousin"), (2, 3, "1st cousin 1 removed"), (3, 4, "2nd cousin 1 removed"), (5, 6, "4th cousin 1 removed"), (0, 0, "-2th great grandparent"), (1, 3, "0th cousin 2 removed"),
]


def test_consanguinity_names(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in KINDS], "da int, db int").select("da", "db", F.expr(A.consanguinity_sql("da", "db")).alias("said"))
    assert {(r["da"], r["db"]): r["said"] for r in df.collect()} == {(a, b): s for a, b, s in KINDS}


def test_unsigned_red(spark):
    df = spark.createDataFrame([(255,), (1,), (7,), (0,)], "u int").select(A.from_unsigned("u", 8).alias("v"))
    assert [r["v"] for r in df.collect()] == [-1, 1, 7, 0]
    assert A.red_one(8, signed=False) == 255 and A.red_one(64, signed=True) == -1


def test_sql_functions(spark):
    A.register(spark)
    row = spark.sql("SELECT avos_product(4, 3) p, avos_sum(0, 5) s, avos_steps(6) t, avos_msb(9) g, avos_lt(3, 0) l, avos_consanguinity(2, 2) c").first()
    assert tuple(row) == (9, 5, "br", 3, True, "1st cousin")
