"""Components, orderings, permutations, submatrices and descriptive figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import msb
from ..plans.scratch import Scratch
from .graph import DensificationError

#: Shares of non-zero cells from which a matrix is reported, and refused.
WARN_DENSITY, MOST_DENSITY = 0.1, 0.5


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 0 in an order, without gathering them in one task.

    They are range-partitioned and written; a number is its place in the
    partition and the sizes of the partitions before, of which there are few.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    dealt = scratch.keep(dealt, "dealt")
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    offset, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, offset))
        offset += sizes[part]
    base = spark.createDataFrame(offsets, "_part long, _base long")
    return dealt.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def roots(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(vertex_id, root)``: the smallest vertex of each one's weak component.

    Alternating large-star and small-star rounds, so long chains take as many
    rounds as the logarithm of their length.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("w")).distinct()
    held, seen = scratch.keep(pairs), None
    while True:
        both = held.union(held.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Written, so that the join with a hub's edges has shuffles on both sides and can be split.
        least = scratch.keep(least, "least")
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("w") == F.col("m"), F.col("u")).otherwise(F.col("w")).alias("u"), F.col("m").alias("w"))
        held = scratch.keep(small.where("u <> w").distinct())
        scratch.only(held)
        row = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)")).alias("s")).first()
        state = (row["n"], row["s"])
        if state == seen:
            break
        seen = state
    linked = held.select(F.col("u").alias("vertex_id"), F.col("w").alias("root"))
    ids = edges.select(F.col("i").alias("vertex_id")).union(edges.select("j"))
    if vertices is not None:
        ids = ids.union(vertices.select("vertex_id"))
    return ids.distinct().join(linked, "vertex_id", "left").select("vertex_id", F.coalesce("root", "vertex_id").alias("root"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(vertex_id, component)``, numbered in the order of the components' smallest vertices."""
    found = roots(edges, vertices)
    ids = numbered(found.select("root").distinct(), [F.col("root")], "component")
    return found.join(ids, "root").select("vertex_id", "component")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def component_vertices(labels: DataFrame) -> DataFrame:
    """``(component, vertices)`` as sorted arrays, for components that fit a row."""
    return labels.groupBy("component").agg(F.sort_array(F.collect_list("vertex_id")).alias("vertices"))


@dataclass
class Ordering:
    """A permuted matrix, ``permutation (old, new)``, and component sizes."""

    matrix: DataFrame
    permutation: DataFrame
    components: DataFrame


def permute(matrix: DataFrame, permutation: DataFrame, upper: bool = False) -> DataFrame:
    """Relabel rows and columns by ``permutation (old, new)``; ``upper`` keeps cells on and over the diagonal."""
    p = permutation
    out = matrix.join(p.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(p.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j")
    out = out.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")
    return out.where("j >= i") if upper else out


def topological_order(closure: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(old, new)``: children before parents.

    A vertex has more ancestors than any of its parents, so the order is by the
    number of closure cells in its row, falling, then by id.
    """
    counts = closure.where("i <> j").groupBy(F.col("i").alias("vertex_id")).agg(F.count("*").alias("ancestors"))
    all_ = vertices.select("vertex_id").join(counts, "vertex_id", "left").fillna(0, ["ancestors"])
    return numbered(all_, [F.col("ancestors").desc(), F.col("vertex_id")], "new").select(F.col("vertex_id").alias("old"), "new")


def topological_ordering(matrix: DataFrame, closure: DataFrame, vertices: DataFrame) -> Ordering:
    """The matrix relabelled to be upper triangular."""
    order = topological_order(closure, vertices)
    labels = connected_components(matrix, vertices)
    return Ordering(permute(matrix, order), order, component_sizes(labels))


def canonical_order(matrix: DataFrame, vertices: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(old, new)`` of the canonical order of a closed matrix with its diagonal.

    By size of the component (falling), component, sum of generations of the row
    (falling), largest value of the column, colour (black first), id. The key is
    not always an upper triangular order.
    """
    labels = connected_components(matrix, vertices) if labels is None else labels
    rows = matrix.groupBy(F.col("i").alias("vertex_id")).agg(F.sum(msb("v").cast("long")).alias("generations"))
    columns = matrix.groupBy(F.col("j").alias("vertex_id")).agg(F.greatest(F.max("v"), F.lit(0)).alias("largest"))
    keyed = vertices.select("vertex_id", "color").join(labels, "vertex_id").join(component_sizes(labels), "component")
    keyed = keyed.join(rows, "vertex_id", "left").join(columns, "vertex_id", "left").fillna(0, ["generations", "largest"])
    order = [F.col("size").desc(), F.col("component"), F.col("generations").desc(), F.col("largest"), F.col("color").desc(), F.col("vertex_id")]
    return numbered(keyed, order, "new").select(F.col("vertex_id").alias("old"), "new")


def canonical_ordering(matrix: DataFrame, vertices: DataFrame) -> Ordering:
    labels = connected_components(matrix, vertices)
    order = canonical_order(matrix, vertices, labels)
    return Ordering(permute(matrix, order), order, component_sizes(labels))


def submatrix(matrix: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells among ``vertices (vertex_id)``, renumbered from 0 by id; and ``(old, new)``."""
    ids = numbered(vertices.select("vertex_id").distinct(), [F.col("vertex_id")], "new").select(F.col("vertex_id").alias("old"), "new")
    return permute(matrix, ids), ids


def merge_components(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Undo :func:`submatrix` for several disjoint parts: each is ``(cells, (old, new))``."""
    back = [permute(cells, ids.select(F.col("new").alias("old"), F.col("old").alias("new"))) for cells, ids in parts]
    out = back[0]
    for b in back[1:]:
        out = out.unionByName(b)
    return out


def is_upper_triangular(matrix: DataFrame, strict: bool = False) -> Column:
    """Aggregate: no cell under the diagonal (nor, if ``strict``, on it)."""
    return F.coalesce(F.bool_and(F.col("j") > F.col("i") if strict else F.col("j") >= F.col("i")), F.lit(True))


def is_lower_triangular(matrix: DataFrame) -> Column:
    return F.coalesce(F.bool_and(F.col("j") <= F.col("i")), F.lit(True))


def degrees(matrix: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(vertex_id, out_degree, in_degree)`` off the diagonal."""
    e = matrix.where("i <> j")
    both = e.select(F.col("i").alias("vertex_id"), F.lit(1).alias("o"), F.lit(0).alias("n")).union(e.select("j", F.lit(0), F.lit(1)))
    sums = both.groupBy("vertex_id").agg(F.sum("o").alias("out_degree"), F.sum("n").alias("in_degree"))
    return vertices.select("vertex_id").join(sums, "vertex_id", "left").fillna(0, ["out_degree", "in_degree"])


def described(values: DataFrame, value: str) -> DataFrame:
    """Count, extremes and moments of a column; the variance is the sample's, skewness and excess kurtosis are the population's."""
    c = F.col(value)
    return values.agg(
        F.count(c).alias("n"),
        F.max(c).cast("long").alias("largest"),
        F.avg(c).alias("mean"),
        F.var_samp(c).alias("variance"),
        F.skewness(c).alias("skewness"),
        F.kurtosis(c).alias("kurtosis"),
    )


def cells_per(matrix: DataFrame, vertices: DataFrame, index: str) -> DataFrame:
    """``(vertex_id, cells)`` of each row or column; empty ones have 0."""
    counts = matrix.groupBy(F.col(index).alias("vertex_id")).agg(F.count("*").alias("cells"))
    return vertices.select("vertex_id").join(counts, "vertex_id", "left").fillna(0, ["cells"])


def identity(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("vertex_id").alias("i"), F.col("vertex_id").alias("j"), F.col("color").cast("long").alias("v"))


def density(matrix: DataFrame, n: int) -> float:
    return matrix.where("v <> 0").count() / (n * n) if n else 0.0


def memory_estimate(n: int, cells: int, value_bytes: int = 8, index_bytes: int = 8) -> dict[str, int]:
    """Bytes of a matrix held dense, compressed by rows, and as rows of three longs."""
    return {"dense": n * n * value_bytes, "compressed": cells * (value_bytes + index_bytes) + (n + 1) * index_bytes, "rows": cells * 24}


@dataclass
class DensityRecord:
    operation: str
    density: float
    nnz: int
    n: int


class DensityMonitor:
    """A history of matrix densities that warns and refuses over its thresholds."""

    def __init__(self, warn: float = WARN_DENSITY, most: float = MOST_DENSITY):
        self.warn, self.most = warn, most
        self.history: list[DensityRecord] = []
        self.warnings: list[str] = []

    def check(self, matrix: DataFrame, n: int, operation: str) -> DensityRecord:
        count = matrix.where("v <> 0").count()
        record = DensityRecord(operation, count / (n * n) if n else 0.0, count, n)
        self.history.append(record)
        if record.density > self.most:
            raise DensificationError(f"{operation}: density {record.density:.3f} is over {self.most}")
        if record.density > self.warn:
            self.warnings.append(f"{operation}: density {record.density:.3f}")
        return record
