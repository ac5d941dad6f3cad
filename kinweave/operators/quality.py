"""Data quality of typed edges, and cycles: reports, exclusions, breaking.

Edges are ``(source, destination, type)``, vertices ``(id, given_name, surname, iteration)``.
"""

from __future__ import annotations

import itertools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: How far an edge type is to be trusted; other types have 30, a missing edge 0.
RELIABILITY = {
    "BiologicalParent": 100,
    "AssumedBiological": 80,
    "UnspecifiedParentType": 60,
    "UntypedParent": 50,
    "AdoptiveParent": 40,
    "StepParent": 20,
    "FosterParent": 10,
    "GuardianParent": 10,
}
OTHER_RELIABILITY, NO_RELIABILITY = 30, 0
#: Types that count towards a high degree, and those of other than biological parents.
PARENT_TYPES = ("BiologicalParent", "AssumedBiological", "UntypedParent")
NONBIO_TYPES = ("StepParent", "FosterParent", "GuardianParent", "AdoptiveParent")


def name(alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return F.concat(F.col(f"{p}given_name"), F.lit(" "), F.col(f"{p}surname"))


def type_distribution(edges: DataFrame) -> DataFrame:
    """``(type, n)`` of each type, and of all under TOTAL."""
    kinds = edges.rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("g"))
    return kinds.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("type")).alias("type"), "n")


def self_loops(edges: DataFrame, vertices: DataFrame, limit: int = 20) -> DataFrame:
    """``(id, name, type)`` of the first edges from a vertex to itself."""
    hit = edges.where("source = destination").join(vertices, F.col("source") == F.col("id"))
    return hit.select("id", name().alias("name"), "type").orderBy("id", "type").limit(limit)


def mutual_edges(edges: DataFrame) -> DataFrame:
    """``(source, destination, type)`` of edges that also exist the other way round."""
    back = edges.select(F.col("destination").alias("source"), F.col("source").alias("destination")).distinct()
    return edges.join(back, ["source", "destination"], "left_semi").select("source", "destination", "type")


def high_degree(edges: DataFrame, vertices: DataFrame, more_than: int = 20, top: int = 10, types: tuple[str, ...] = PARENT_TYPES) -> DataFrame:
    """``(id, name, children)`` of the vertices with the most children, over a threshold."""
    counts = edges.where(F.col("type").isin(*types)).groupBy(F.col("destination").alias("id")).agg(F.count("*").alias("children"))
    most = counts.where(F.col("children") > more_than).join(vertices, "id")
    return most.select("id", name().alias("name"), "children").orderBy(F.desc("children"), "id").limit(top)


def nonbio_edges(edges: DataFrame, vertices: DataFrame, top: int = 20, types: tuple[str, ...] = NONBIO_TYPES) -> DataFrame:
    """``(id, name, type, n)``: children with the most parents of a type that is not biological."""
    counts = edges.where(F.col("type").isin(*types)).groupBy(F.col("source").alias("id"), "type").agg(F.count("*").alias("n"))
    return counts.join(vertices, "id").select("id", name().alias("name"), "type", "n").orderBy(F.desc("n"), "id", "type").limit(top)


def mutual_exclusions(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(from_id, to_id, reason)``: of two opposite edges, the one that leads inward goes.

    The edge that stays leads to the vertex of the higher iteration; on ties the
    edge from the smaller id goes.
    """
    e = edges.select("source", "destination").where("source <> destination").distinct()
    back = e.select(F.col("source").alias("d2"), F.col("destination").alias("s2"))
    pairs = e.where("source < destination").join(back, (F.col("source") == F.col("s2")) & (F.col("destination") == F.col("d2")), "left_semi")
    hop = vertices.select("id", F.coalesce("iteration", F.lit(0)).alias("h"))
    pairs = pairs.join(hop.select(F.col("id").alias("source"), F.col("h").alias("h1")), "source", "left")
    pairs = pairs.join(hop.select(F.col("id").alias("destination"), F.col("h").alias("h2")), "destination", "left").fillna(0, ["h1", "h2"])
    forward_goes = F.col("h1") >= F.col("h2")
    return pairs.select(
        F.when(forward_goes, F.col("source")).otherwise(F.col("destination")).alias("from_id"),
        F.when(forward_goes, F.col("destination")).otherwise(F.col("source")).alias("to_id"),
        F.when(F.col("h1") == F.col("h2"), "same hop").otherwise("inward edge").alias("reason"),
    )


def edges_of_types(edges: DataFrame, vertices: DataFrame, types: list[str]) -> DataFrame:
    """``(source, source_name, destination, destination_name, type)`` of the types asked for."""
    e = edges.where(F.col("type").isin(*types))
    a = vertices.select(F.col("id").alias("source"), name().alias("source_name"))
    b = vertices.select(F.col("id").alias("destination"), name().alias("destination_name"))
    return e.join(a, "source").join(b, "destination").select("source", "source_name", "destination", "destination_name", "type")


def apply_exclusions(matrix: DataFrame, edges: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """A matrix without excluded ``edges (i, j)`` and without the edges of excluded ``vertices (vertex_id)``; its diagonal stays."""
    rest = matrix.where("i <> j")
    if edges is not None:
        rest = rest.join(edges.select("i", "j"), ["i", "j"], "left_anti")
    if vertices is not None:
        for side in ("i", "j"):
            rest = rest.join(vertices.select(F.col("vertex_id").alias(side)), side, "left_anti")
    return rest.select("i", "j", "v").unionByName(matrix.where("i = j").select("i", "j", "v"))


def reliability(kind: Column) -> Column:
    out = F.lit(OTHER_RELIABILITY)
    for k, score in RELIABILITY.items():
        out = F.when(kind == k, score).otherwise(out)
    return F.when(kind.isNull(), NO_RELIABILITY).otherwise(out).cast("long")


def edge_reliability(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source, destination, type, score)`` for ``pairs``; 0 where there is no edge."""
    return pairs.join(edges.select("source", "destination", "type"), ["source", "destination"], "left").withColumn("score", reliability(F.col("type")))


def relationship_types(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source, destination, type)`` of pairs; ``Unknown`` where there is no edge."""
    return pairs.join(edges, ["source", "destination"], "left").select("source", "destination", F.coalesce("type", F.lit("Unknown")).alias("type"))


def shortest_cycle(edges: DataFrame, start: int, max_length: int | None = None) -> list[int] | None:
    """The vertices of a shortest cycle through ``start``, which ends it too; the smallest path on ties.

    A breadth-first search that keeps one path a vertex and ends when no new
    vertex is reached. A caller's ``max_length`` warns where it ends the search.
    """
    scratch = Scratch(edges.sparkSession, "cycle")
    pairs = edges.select("i", "j").distinct()
    front = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("at"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = None
    for _ in itertools.count() if max_length is None else range(max_length):
        moved = front.join(pairs, front["at"] == pairs["i"]).select(F.col("j").alias("at"), F.concat("path", F.array("j")).alias("path"))
        moved = moved.groupBy("at").agg(F.min("path").alias("path"))
        if seen is not None:
            moved = moved.join(seen, "at", "left_anti")
        front = scratch.keep(moved, "front")
        closed = front.where(F.col("at") == start).first()
        if closed or front.isEmpty():
            scratch.only()
            return list(closed["path"]) if closed else None
        seen = scratch.keep(front.select("at") if seen is None else seen.union(front.select("at")), "seen")
    warnings.warn(f"no cycle of up to {max_length} edges; longer ones were not searched", stacklevel=2)
    return None


def _trimmed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct edges that are left when sources and sinks are taken off until there are none."""
    pairs = scratch.keep(edges.select("i", "j").distinct(), "edges")
    count = pairs.count()
    while True:
        less = pairs.join(pairs.select(F.col("j").alias("i")).distinct(), "i", "left_semi").join(pairs.select(F.col("i").alias("j")).distinct(), "j", "left_semi")
        less = scratch.keep(less.select("i", "j"), "edges")
        n = less.count()
        scratch.drop(pairs)
        if n == count:
            return less
        pairs, count = less, n


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """``(cycle)`` of all simple cycles, each from its smallest vertex on.

    A caller's ``max_length`` leaves out cycles of more edges, and warns when
    paths were still open.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    pairs = _trimmed(edges, scratch)
    walk = pairs.where("j >= i").select(F.col("i").alias("start"), F.col("j").alias("at"), F.array("i").alias("cycle"))
    found = walk.where("at = start").select("cycle")
    walk = scratch.keep(walk.where("at <> start"), "walk")
    for length in itertools.count(1):
        if walk.isEmpty():
            break
        if max_length is not None and length >= max_length:
            warnings.warn(f"cycles of more than {max_length} edges were not searched", stacklevel=2)
            break
        moved = walk.select("start", "at", F.concat("cycle", F.array("at")).alias("cycle")).join(pairs, F.col("at") == F.col("i"))
        moved = scratch.keep(moved.where("j >= start and (j = start or not array_contains(cycle, j))").select("start", F.col("j").alias("at"), "cycle"), "walk")
        found = found.union(moved.where("at = start").select("cycle"))
        walk = moved.where("at <> start")
    return found


def weakest_links(cycles: DataFrame, scored: DataFrame) -> DataFrame:
    """``(cycle, source, destination, score)``: the least reliable edge of each cycle, the first on ties.

    ``scored (source, destination, score)``; an edge that is not there has 0.
    """
    n = F.size("cycle")
    links = cycles.select("cycle", F.posexplode("cycle").alias("at", "source"))
    links = links.withColumn("destination", F.element_at("cycle", (F.col("at") + 1) % n + 1))
    links = links.join(scored.select("source", "destination", "score"), ["source", "destination"], "left").fillna(0, ["score"])
    best = F.min_by(F.struct("source", "destination", "score"), F.struct("score", "at")).alias("b")
    return links.groupBy("cycle").agg(best).select("cycle", "b.source", "b.destination", "b.score")


def break_cycles(cycles: DataFrame, edges: DataFrame, strategy: str = "weakest_link") -> DataFrame:
    """``(source, destination)`` of edges whose removal breaks the cycles; none for ``manual``.

    ``step_adoptive`` and ``untyped`` take all edges of those types on a cycle.
    """
    pairs = cycles.select("cycle", F.posexplode("cycle").alias("at", "source"))
    pairs = pairs.select("source", F.element_at("cycle", (F.col("at") + 1) % F.size("cycle") + 1).alias("destination")).distinct()
    if strategy == "weakest_link":
        return weakest_links(cycles, edge_reliability(pairs, edges)).select("source", "destination").distinct()
    kinds = {"step_adoptive": list(NONBIO_TYPES), "untyped": ["UntypedParent"], "manual": []}
    if strategy not in kinds:
        raise ValueError(f"unknown strategy {strategy!r}")
    return relationship_types(pairs, edges).where(F.col("type").isin(*kinds[strategy]) if kinds[strategy] else F.lit(False)).select("source", "destination").distinct()


def cycle_participants(edges: DataFrame) -> DataFrame:
    """``(vertex_id)`` of the vertices on any cycle: those of strongly connected components of more than one vertex, and of loops.

    Components are found by colouring: each vertex takes the largest one that
    reaches it, and those that reach that one back inside its colour are its
    component. Components go, edges between colours too, and the rest is trimmed
    again; nothing is closed.
    """
    scratch = Scratch(edges.sparkSession, "participants")
    found, kept = edges.where("i = j").select(F.col("i").alias("vertex_id")), []
    rest = _trimmed(edges.where("i <> j"), scratch)
    while not rest.isEmpty():
        ids = rest.select(F.col("i").alias("vertex_id")).distinct()
        color = _spread(ids.withColumn("c", F.col("vertex_id")), rest, scratch)
        # Edges between two colours lie on no cycle.
        a = color.select(F.col("vertex_id").alias("i"), F.col("c").alias("a"))
        inner = rest.join(a, "i").join(color.select(F.col("vertex_id").alias("j"), F.col("c").alias("b")), "j").where("a = b")
        inner = scratch.keep(inner.select("i", "j"), "inner")
        back = inner.select(F.col("j").alias("i"), F.col("i").alias("j"))
        reach = _spread(color.where("vertex_id = c"), back, scratch).select("vertex_id")
        # A component of one vertex was left in by trimming, since a cycle lies before and after it.
        ends = inner.join(reach.withColumnRenamed("vertex_id", "i"), "i").select(F.col("j").alias("vertex_id")).distinct()
        part = scratch.keep(reach.join(ends, "vertex_id", "left_semi"), "part")
        kept.append(part)
        found = found.union(part)
        for side in ("i", "j"):
            inner = inner.join(reach.withColumnRenamed("vertex_id", side), side, "left_anti")
        rest = _trimmed(inner, scratch)
        scratch.only(rest, *kept)
    scratch.only(*kept)
    return found.distinct()


def _spread(start: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(vertex_id, c)``: the largest value that reaches each vertex along ``pairs (i, j)``; only values that grew move on."""
    held = front = scratch.keep(start, "color")
    while True:
        moved = front.withColumnRenamed("vertex_id", "i").join(pairs, "i").groupBy(F.col("j").alias("vertex_id")).agg(F.max("c").alias("c"))
        grown = moved.join(held.withColumnRenamed("c", "had"), "vertex_id", "left").where("had is null or c > had").select("vertex_id", "c")
        grown = scratch.keep(grown, "grown")
        if grown.isEmpty():
            return held
        now = scratch.keep(held.union(grown).groupBy("vertex_id").agg(F.max("c").alias("c")), "color")
        if front is not held:
            scratch.drop(front)
        scratch.drop(held)
        held, front = now, grown
