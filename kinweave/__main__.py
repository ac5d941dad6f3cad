"""Command line: ``python -m kinweave run|synthesize|exclusions``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import closure, quality, structure, synth
from .operators.graph import CycleError
from .sources import files


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    graph, counts = files.read_relationships(spark, a.vertices, a.edges, a.types.split(","), a.hops, a.invalid, a.invalid_reasons.split(",") if a.invalid_reasons else None, a.ignore)
    report = dict(counts) | {"edges": graph.edges.count()}
    try:
        began = time.time()
        done = closure.transitive_closure(graph.edges)
        report |= {"closure_seconds": round(time.time() - began, 3), "diameter": done.diameter}
        closed = done.paths.unionByName(structure.identity(graph.vertices))
        closed.write.mode("overwrite").parquet(f"{a.out}/closure")
        for side in ("i", "j"):
            report[f"cells_{side}"] = structure.described(structure.cells_per(closed, graph.vertices, side), "cells").first().asDict()
        if a.canonical:
            ordering = structure.canonical_ordering(closed, graph.vertices)
            ordering.matrix.write.mode("overwrite").parquet(f"{a.out}/canonical")
            ordering.permutation.write.mode("overwrite").parquet(f"{a.out}/order")
            report["components"] = structure.described(ordering.components, "size").first().asDict()
        if a.topological:
            structure.topological_order(done.paths, graph.vertices).write.mode("overwrite").parquet(f"{a.out}/topological")
    except CycleError as error:
        who = graph.vertices.where(F.col("vertex_id") == error.vertex).select("external_id").first()
        report |= {"cycle_vertex": who["external_id"] if who else error.vertex, "cycle": quality.shortest_cycle(graph.edges, error.vertex)}
    print(json.dumps(report, default=str))


def _synthesize(spark: SparkSession, a: argparse.Namespace) -> None:
    result = synth.synthesize(spark, synth.SynthesizerConfig(a.initial, num_generations=a.generations, seed=a.seed, max_total_vertices=a.max_vertices))
    files.write_synthesis(result, a.out)
    print(json.dumps(result.stats))


def _exclusions(spark: SparkSession, a: argparse.Namespace) -> None:
    vertices, edges = files.read_sqlite(spark, a.db)
    quality.mutual_exclusions(edges, vertices).write.mode("overwrite").json(a.out)


def main() -> None:
    top = argparse.ArgumentParser(prog="kinweave")
    sub = top.add_subparsers(required=True)
    run = sub.add_parser("run", help="read relationship files, close and order the graph")
    for name in ("vertices", "edges", "out"):
        run.add_argument(name)
    run.add_argument("--types", default="BiologicalParent,AssumedBiological,UntypedParent,Bio")
    run.add_argument("--hops", type=int, default=4)
    for name in ("invalid", "invalid-reasons", "ignore"):
        run.add_argument(f"--{name}")
    run.add_argument("--canonical", action="store_true")
    run.add_argument("--topological", action="store_true")
    run.set_defaults(do=_run)
    make = sub.add_parser("synthesize", help="make a family")
    make.add_argument("out")
    make.add_argument("--initial", type=int, default=50)
    make.add_argument("--generations", type=int, default=4)
    make.add_argument("--seed", type=int, default=0)
    make.add_argument("--max-vertices", type=int)
    make.set_defaults(do=_synthesize)
    cut = sub.add_parser("exclusions", help="exclusions for opposite edges of a database")
    cut.add_argument("db")
    cut.add_argument("out")
    cut.set_defaults(do=_exclusions)
    a = top.parse_args()
    a.do(SparkSession.builder.appName("kinweave").getOrCreate(), a)


if __name__ == "__main__":
    main()
