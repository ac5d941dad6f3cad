"""The closure of a graph whose edges fit in memory, walked from blocks of sources.

A fixpoint of joins makes a pair once for each vertex in the middle of one of
its paths, and shuffles each of these rows. Here the edges go to every task, as
the small side of a join would, and a task walks from its own sources: nothing
is shuffled or written, and rows leave as they are found.

Vertices are visited by falling level, the length of the longest path from a
vertex. All paths to a vertex come from higher levels, so its least value is
known when its level is reached, and each pair is extended once by each parent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.algebra import MAX_GENERATIONS

#: Edges (of at most 25 bytes) that are sent to every task at most.
MAX_EDGES = 4_000_000
#: Sources walked from together, and pairs held meanwhile; a block that finds more is halved.
BLOCK, MAX_PAIRS = 4_096, 4_000_000
#: Sources of a task, and rows of a batch that leaves it.
TASK, BATCH = 8_192, 500_000


def _levels(first: np.ndarray, to: np.ndarray) -> np.ndarray | None:
    """The length of the longest path from each vertex; None if one has no end or more than 62 generations."""
    level = np.zeros(len(first) - 1, np.uint8)
    inner = np.flatnonzero(np.diff(first))
    if not len(inner):
        return level
    for _ in range(MAX_GENERATIONS + 1):
        now = np.maximum.reduceat(level[to], first[inner]) + np.uint8(1)
        if (now == level[inner]).all():
            return level
        level[inner] = now
    return None


def _packed(table: pa.Table) -> tuple[np.ndarray, ...] | None:
    """Vertices in order, and for each its place in the list of edges: ``(ids, first, to, step, level)``."""
    i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
    ids = np.union1d(i, j)
    at = np.searchsorted(ids, i).astype(np.int32)
    order = np.argsort(at, kind="stable")
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=len(ids)), out=first[1:])
    to, step = np.searchsorted(ids, j).astype(np.int32)[order], (v[order] & 1).astype(np.uint8)
    level = _levels(first, to)
    return None if level is None else (ids, first, to, step, level)


def _least(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its least value."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new], np.minimum.reduceat(v[order], new)


def _found(graph: tuple[np.ndarray, ...], sources: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """All paths from ``sources``: place of the source times the number of vertices plus the end, and the value. None if they are too many for a block."""
    ids, first, to, step, level = graph
    n, rows, found = len(ids), 0, []
    waiting: dict[int, list] = defaultdict(list)

    def wait(key: np.ndarray, v: np.ndarray, end: np.ndarray) -> None:
        order = np.argsort(level[end], kind="stable")
        cuts = np.cumsum(np.bincount(level[end]))
        for at, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            if a < b:
                waiting[at].append((key[order[a:b]], v[order[a:b]]))

    wait(np.arange(len(sources)) * n + sources, np.ones(len(sources), np.int64), sources)
    for at in range(int(level[sources].max()), -1, -1):
        if at not in waiting:
            continue
        key, v = _least(*map(np.concatenate, zip(*waiting.pop(at), strict=True)))
        end = key % n
        found.append((key[v > 1], v[v > 1]))
        rows += len(key)
        start, parents = first[end], first[end + 1] - first[end]
        made = int(parents.sum())
        if len(sources) > 1 and rows + made + sum(len(k) for w in waiting.values() for k, _ in w) > MAX_PAIRS:
            return None
        if made:
            edge = np.repeat(start - np.cumsum(parents) + parents, parents) + np.arange(made)
            parent = to[edge]
            wait(np.repeat(key - end, parents) + parent, np.repeat(v << 1, parents) | step[edge], parent)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _walked(graph: tuple[np.ndarray, ...], sources: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, at, size = graph[0], 0, BLOCK
    while at < len(sources):
        block = sources[at : at + size]
        found = _found(graph, block)
        if found is None:
            size = len(block) // 2
            continue
        at += len(block)
        for low in range(0, len(found[0]), BATCH):
            key, v = (x[low : low + BATCH] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[block[key // len(ids)]]), pa.array(ids[key % len(ids)]), pa.array(v)], ["i", "j", "v"])


def paths(edges: DataFrame) -> DataFrame | None:
    """The closure ``(i, j, v)`` of edges of one step, off the diagonal.

    None where it is not made this way: over ``MAX_EDGES`` edges, values beyond
    3, null ends, cycles, or paths of more than 62 generations.
    """
    spark = edges.sparkSession
    proper = edges.where("v >= 2").selectExpr("cast(i as bigint) i", "cast(j as bigint) j", "cast(v as bigint) v")
    seen = proper.selectExpr("count(*) n", "count_if(v > 3 or i is null or j is null) odd").first()
    if seen["n"] > MAX_EDGES or seen["odd"]:
        return None
    graph = _packed(proper.toArrow())
    if graph is None:
        return None
    held, n = spark.sparkContext.broadcast(graph), len(graph[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _walked(held.value, batch.column(0).to_numpy())

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK))
    return spark.range(0, n, 1, tasks).mapInArrow(run, "i long, j long, v long")
