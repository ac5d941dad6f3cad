"""Readers and writers of graphs: relationship files, databases, caches, reports."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, cells_to_wide
from ..operators.structure import numbered

VERTEX_COLUMNS = "id STRING, color STRING, name STRING, hop INT"
EDGE_COLUMNS = "source STRING, destination STRING, type STRING"
INVALID_COLUMNS = EDGE_COLUMNS + ", reason STRING"
#: Columns that a spreadsheet can have.
MAX_COLUMNS = 16_384


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV without header; lines that begin with ``#`` are skipped. Rows keep their place in the file."""
    df = spark.read.schema(schema).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    return df.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())


def read_relationships(
    spark: SparkSession,
    vertices: str,
    edges: str,
    types: list[str],
    max_hop: int,
    invalid: str | None = None,
    invalid_reasons: list[str] | None = None,
    ignore: str | None = None,
) -> tuple[Graph, dict[str, int]]:
    """A graph from relationship files, and counts of what was left out.

    Persons without colour or beyond ``max_hop`` are left out; edges are taken by
    type. Persons are numbered in file order. Edges of the invalid file count as
    links by ``invalid_reasons``, but are added for every reason except
    ``frontier``. A repeated edge counts once. Ignored edges are not added.
    """
    people = _csv(spark, vertices, VERTEX_COLUMNS)
    kept = people.where(F.col("hop") <= max_hop).where("color is not null and color <> ''")
    ids = numbered(kept.select("id", "color", "name", "hop", "_file", "_at"), [F.col("_file"), F.col("_at")], "vertex_id")
    ids = ids.select("vertex_id", F.col("color").cast("int").alias("color"), F.col("id").alias("external_id"), "name", "hop")
    typed = _csv(spark, edges, EDGE_COLUMNS).where(F.col("type").isin(*types)).select("source", "destination")
    links, added = typed, typed
    if invalid:
        bad = _csv(spark, invalid, INVALID_COLUMNS).where(F.col("type").isin(*types))
        links = links.union(bad.where(F.col("reason").isin(*(invalid_reasons or [""]))).select("source", "destination"))
        added = added.union(bad.where("reason <> 'frontier'").select("source", "destination"))
    if ignore:
        skip = _csv(spark, ignore, "source STRING, destination STRING").select("source", "destination")
        added = added.join(skip, ["source", "destination"], "left_anti")
    child = ids.select(F.col("external_id").alias("source"), F.col("vertex_id").alias("i"))
    parent = ids.select(F.col("external_id").alias("destination"), F.col("vertex_id").alias("j"), F.col("color").alias("pc"))
    value = F.when(F.col("pc") == -1, 2).otherwise(3).cast("long").alias("v")
    out = added.distinct().join(child, "source").join(parent, "destination").select("i", "j", value)
    inside = links.join(child, "source", "left_semi").join(parent, "destination", "left_semi")
    linked = inside.select(F.col("source").alias("external_id")).union(inside.select("destination")).distinct()
    row = people.agg(F.count_if(F.col("hop") > max_hop).alias("hop"), F.count_if((F.col("hop") <= max_hop) & (F.col("color").isNull() | (F.col("color") == ""))).alias("color")).first()
    counts = {
        "beyond_hop_limit": row["hop"],
        "without_color": row["color"],
        "vertices": ids.count(),
        "without_edges": ids.join(linked, "external_id", "left_anti").count(),
    }
    return Graph(ids, out, strict=False), counts


def person_id(graph: Graph, external_id: str) -> int | None:
    row = graph.vertices.where(F.col("external_id") == external_id).select("vertex_id").first()
    return row["vertex_id"] if row else None


def relabel(graph: Graph, order: DataFrame) -> Graph:
    """A graph with new ids by ``order (old, new)``."""
    new = order.select(F.col("old").alias("vertex_id"), "new")
    vertices = graph.vertices.join(new, "vertex_id").drop("vertex_id").withColumnRenamed("new", "vertex_id")
    a, b = (new.select(F.col("vertex_id").alias(c), F.col("new").alias(f"n{c}")) for c in ("i", "j"))
    edges = graph.edges.join(a, "i").join(b, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")
    return Graph(vertices, edges, graph.strict)


def build_graph(vertices: DataFrame, parents: DataFrame) -> Graph:
    """A graph from ``vertices (vertex_id, color)`` and ``parents (i, j)``; an edge's value is its parent's colour."""
    color = vertices.select(F.col("vertex_id").alias("j"), F.col("color").alias("pc"))
    edges = parents.select("i", "j").distinct().join(color, "j").select("i", "j", F.when(F.col("pc") == -1, 2).otherwise(3).cast("long").alias("v"))
    return Graph(vertices, edges)


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(from_id, to_id, reason)`` and ``(vertex_id, reason)`` of an exclusions file."""
    schema = (
        "excluded_edges array<struct<from_id:string,to_id:string,reason:string,comment:string>>,"
        "excluded_vertices array<struct<vertex_id:string,reason:string>>"
    )
    file = spark.read.schema(schema).option("multiLine", True).json(path)
    edges = file.select(F.explode("excluded_edges").alias("e")).select("e.from_id", "e.to_id", "e.reason")
    return edges, file.select(F.explode("excluded_vertices").alias("v")).select("v.vertex_id", "v.reason")


def read_sqlite(spark: SparkSession, path: str, max_hop: int | None = None, chunk: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """``vertices`` and ``edges`` of a database file, read through the driver in chunks."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:

        def table(sql: str, schema: str) -> DataFrame:
            rows, out = db.execute(sql), None
            while True:
                part = rows.fetchmany(chunk)
                if part or out is None:
                    df = spark.createDataFrame(part, schema)
                    out = df if out is None else out.unionByName(df)
                if len(part) < chunk:
                    return out

        vertices = table("SELECT id, given_name, surname, iteration FROM VERTEX", "id string, given_name string, surname string, iteration long")
        edges = table("SELECT source, destination, type FROM EDGE", "source string, destination string, type string")
    if max_hop is not None:
        vertices = vertices.where(F.coalesce("iteration", F.lit(0)) <= max_hop)
        for side in ("source", "destination"):
            edges = edges.join(vertices.select(F.col("id").alias(side)), side, "left_semi")
    return vertices, edges


def save_graph(graph: Graph, path: str, metadata: dict) -> None:
    """A cache of a graph: two tables, and metadata that tell whether it is still valid."""
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.repartition("i").sortWithinPartitions("i", "j").write.mode("overwrite").parquet(f"{path}/edges")
    spark = graph.vertices.sparkSession
    spark.createDataFrame([(json.dumps(metadata | {"strict": graph.strict}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def cache_metadata(spark: SparkSession, path: str) -> dict | None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not at.getFileSystem(conf).exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def cache_valid(spark: SparkSession, path: str, metadata: dict, sources: tuple[str, ...] = ()) -> bool:
    """Whether a cache has this metadata and is newer than its sources."""
    held = cache_metadata(spark, path)
    if held is None or {k: v for k, v in held.items() if k != "strict"} != metadata:
        return False
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def changed(p: str) -> int:
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(conf).getFileStatus(at).getModificationTime()

    made = changed(f"{path}/metadata")
    return all(changed(s) <= made for s in sources)


def load_graph(spark: SparkSession, path: str) -> Graph:
    held = cache_metadata(spark, path)
    if held is None:
        raise FileNotFoundError(path)
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), held["strict"])


def write_matrix_csv(matrix: DataFrame, n: int, path: str, names: list[str] | None = None) -> None:
    """A dense table with a header, for matrices that fit a spreadsheet; a red self is shown as 1."""
    wide = cells_to_wide(matrix.select("i", "j", F.when(F.col("v") == -1, 1).otherwise(F.col("v")).alias("v")), n, MAX_COLUMNS)
    header = names or [str(k) for k in range(n)]
    wide.orderBy("i").select(F.col("i").alias("vertex"), *[F.col(f"c{k}").alias(h) for k, h in enumerate(header)]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def capture(matrix: DataFrame, n: int, limit: int = 200) -> str:
    """A small matrix as text: cells up to 9 but -1 are padded to two characters."""
    if n > limit:
        raise ValueError(f"only matrices of up to {limit} rows are shown")
    cells = {(r["i"], r["j"]): r["v"] for r in matrix.where((F.col("i") < n) & (F.col("j") < n)).collect()}
    shown = lambda v: f" {v}" if v != -1 and v < 10 else str(v)
    rows = ("  [" + ",".join(shown(cells.get((i, j), 0)) for j in range(n)) + "]" for i in range(n))
    return "[\n" + ",\n".join(rows) + "\n]"


def write_synthesis(result, path: str) -> None:
    """Individuals, reader-compatible vertices and edges, the matrix and the figures, each under ``path``."""
    people, g = result.individuals, result.graph
    sex = F.when(F.col("color") == -1, "M").otherwise("F").alias("gender")
    people.select("vertex_id", "first_name", "last_name", sex, "generation", "father_id", "mother_id").write.mode("overwrite").option("header", True).csv(f"{path}/individuals")
    people.select("vertex_id", "color", F.concat_ws(" ", "first_name", "last_name").alias("name"), "generation").write.mode("overwrite").csv(f"{path}/vertices")
    g.edges.select("i", "j", F.lit("parent-child")).write.mode("overwrite").csv(f"{path}/edges")
    g.matrix().write.mode("overwrite").parquet(f"{path}/matrix")
    people.sparkSession.createDataFrame([(json.dumps(result.stats, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
