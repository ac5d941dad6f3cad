"""Connected components, and pair work inside groups of any size.

Groups are never collected whole: a group over the block budget is dealt into
blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; the component is its smallest node.

    Alternating large-star and small-star rounds; every round is a written
    table. Hot nodes are aggregated before the shuffle, and the join that
    follows is one Spark can split. Null ends are not edges.
    """
    held = scratch.keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Written, so that the join with a hub's edges has shuffles on both sides and can be split.
        low_table = scratch.keep(low, "low")
        large = both.where("v > u").join(low_table, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.where("u <> v").distinct(), "edges")
        scratch.drop(held, low_table)
        held = now
        state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixpoint of the components after {max_rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        held.select("v", "v").distinct()
    )


@dataclass
class Linked:
    """What a similarity join found, in written tables.

    ``rows (id, k1, k2)``: each distinct pair of an id and a content, the latter
    as two hashes; ``nodes (k1, k2, node, low, copies)``: each content, its
    smallest id and its number of ids; ``links (node, links, peer)``: parts of a
    node's links, counted in ids, and edges of a spanning forest.
    """

    rows: DataFrame
    nodes: DataFrame
    links: DataFrame
    scratch: Scratch

    def several(self) -> DataFrame | None:
        """``(id)`` of the ids with more than one content; None if there are none, which is the rule."""
        ends = self.rows.groupBy("id").agg(*[f(k).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in ("k1", "k2")])
        found = self.scratch.keep(ends.where("mink1 <> maxk1 or mink2 <> maxk2").select("id"), "several")
        return None if found.isEmpty() else found

    def classes(self, lowest: list[str], more: DataFrame | None = None) -> DataFrame:
        """``(node, *lowest)``: for each linked node, the least values of these columns of ``nodes`` in its component; ``more (u, v)`` are further edges."""
        edges = self.links.select(F.col("node").alias("u"), F.col("peer").alias("v"))
        joined = components(edges if more is None else edges.union(more), self.scratch)
        joined = self.scratch.keep(joined, "joined")
        first = F.col(lowest[0]) if len(lowest) == 1 else F.struct(*lowest)
        least = joined.join(self.nodes.select("node", *lowest), "node").groupBy("component").agg(F.min(first).alias("_least"))
        least = least.select("component", *([F.col("_least").alias(lowest[0])] if len(lowest) == 1 else [f"_least.{c}" for c in lowest]))
        # Written, so that a component with a share of all nodes is dealt out by a join that Spark can split.
        return self.scratch.keep(joined.join(self.scratch.keep(least, "least"), "component").select("node", *lowest), "classes")

    def by_id(self) -> DataFrame:
        """``(id, class_id, copy_of, n_links)``: one row an id that has a copy or a link.

        An id's contents are one document: its links are all of theirs, and its
        class is the least id reachable from any of them.
        """
        several = self.several()
        more = None
        if several is not None:
            own = self.rows.join(several, "id").join(self.nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node")
            own = self.scratch.keep(own, "own")
            more = own.join(own.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v")
        classes = self.classes(["low"], more).select("node", F.col("low").alias("class_id"))
        counted = self.links.groupBy("node").agg(F.sum("links").alias("links"))
        state = self.nodes.join(counted, "node", "left").join(classes, "node", "left").where("copies > 1 or links is not null or class_id is not null")
        state = state.select(
            "k1", "k2", F.col("low").alias("copy_of"), F.coalesce("class_id", "low").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
        )
        found = self.rows.join(state, ["k1", "k2"]).select("id", "class_id", "copy_of", "n_links")
        if several is None:
            return found
        return found.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.sum("n_links").alias("n_links"))

    def surplus(self) -> DataFrame:
        """``(id, k1, k2)`` of all rows but one of each class: the one of the least id, and of the least content on ties."""
        least = self.nodes.withColumn("c1", F.col("k1")).withColumn("c2", F.col("k2"))
        classes = Linked(self.rows, least, self.links, self.scratch).classes(["low", "c1", "c2"])
        state = self.nodes.withColumnRenamed("low", "own").join(classes, "node", "left").where("copies > 1 or low is not null")
        state = state.select("k1", "k2", F.coalesce("low", "own").alias("low"), F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2"))
        return self.rows.join(state, ["k1", "k2"]).where("id <> low or k1 <> c1 or k2 <> c2").select("id", "k1", "k2")


def numbered_contents(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(k1, k2, node, low, copies)`` of ``rows (id, k1, k2)``, written with a number for each content."""
    held = rows.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count_distinct("id").alias("copies"))
    return scratch.keep(held.withColumn("node", F.monotonically_increasing_id()), "nodes")


def dealt(df: DataFrame, key: str, row: str, blocks: Column) -> DataFrame:
    """Deal each group ``key`` into ``blocks`` blocks by the hash of ``row``, one copy of a row for each partner block.

    Adds ``bi <= bj``, the pair of blocks, and ``own``, the row's block.
    """
    own = F.when(blocks > 1, F.pmod(F.xxhash64(row, F.lit(11)), blocks)).otherwise(F.lit(0)).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("other")
    )


def across(table: pa.Table) -> bool:
    """Whether a task of :func:`dealt` compares two blocks: only rows of different blocks are pairs then, even if one block is empty."""
    return table.column("bi")[0].as_py() != table.column("bj")[0].as_py()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, over batch borders; the rows come sorted by the keys."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(len(table), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        begins = np.flatnonzero(change)
        for k, begin in enumerate(begins):
            end = begins[k + 1] if k + 1 < len(begins) else len(table)
            key = tuple(c[begin] for c in columns)
            part = table.slice(begin, end - begin)
            if key == held_key:
                held.append(part)
            else:
                if held:
                    yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held, held_key = [part], key
    if held:
        yield pa.concat_tables(held) if len(held) > 1 else held[0]


def in_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to each group of ``keys``; small results are gathered into larger batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for table in grouped(batches, keys):
            made = work(table)
            if made is not None and made.num_rows:
                out.append(made)
                rows += made.num_rows
            if rows >= 20_000 or len(out) >= 2_000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, rows = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def labelled(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable over a symmetric boolean matrix, for each index."""
    return reached(len(near), *np.nonzero(near))


def reached(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The smallest index reachable over edges that are given both ways, for each of ``n``."""
    label = np.arange(n)
    while len(rows):
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label
