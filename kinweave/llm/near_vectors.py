"""Embedding near-duplicates by spherical-cap filters.

A product code cuts a rotated space into ``PARTS`` blocks, each with a random
codebook of directions; a filter is one codeword of every block, so the filters
are all combinations. A vector falls into every filter whose direction it
exceeds a threshold with. These are list-decoded: block by block, partial sums
that no rest can lift over the threshold go. Vectors are joined on their
filters and verified in double precision.

Filters of one code hang together: a vector that lies badly in it falls into
few. So there are ``CODES`` codes, each with a rotation of its own, in which a
vector falls into ``FILTERS`` filters on average. Caps hold about ``CAP_ROWS``
chance vectors each, so codebooks grow with the number of vectors. Of pairs at
the threshold, in 64 dimensions, 99.7 % share a filter; closer ones nearly all.

What goes to a filter is a number and ``BITS`` signs of random projections, no
vector. Members whose signs may be those of a link are joined to a group, and
only a spanning forest leaves a task. Inside a group all vectors are compared in
double precision by matrix products, large groups block by block; so a vector
travels once for each pair of blocks, a pair is counted once, and no pair leaves
a task: only counts and forests. Equal vectors are one, with its number of ids.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing; vectors of different lengths link with none of
another length; a null id links with nothing and has a null component and
``kept``; a repeated row is one vector; the vectors of one id are all compared,
their links are the id's (those among them too); an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .links import Linked, across, components, dealt, grouped, in_groups, labelled, numbered_contents, reached
from .shared import Scratch

COSINE = 0.95
PARTS, CODES, FILTERS, CAP_ROWS = 2, 10, 3, 16
#: Vectors of a block of a filter or a group, members up to which filters are compared together, and rows that are.
BLOCK_ROWS, SMALL, TOGETHER = 512, 48, 20_000
#: Signs of random projections by which members of a filter are compared first.
BITS = 128


@dataclass(frozen=True)
class Caps:
    """A rotation, a codebook for each block, and the threshold."""

    basis: np.ndarray
    books: list[np.ndarray]
    least: float


def cap_share(dim: int, angles: np.ndarray) -> np.ndarray:
    """Share of the sphere within each angle of a direction."""
    grid = np.linspace(0, math.pi, 100_001)
    density = np.sin(grid) ** (dim - 2) if dim > 2 else np.ones_like(grid)
    total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return np.interp(angles, grid, total / total[-1])


def plan_caps(
    dim: int, rows: int, cosine: float = COSINE, parts: int = PARTS, codes: int = CODES, filters: int = FILTERS, cap_rows: int = CAP_ROWS, seed: int = 17
) -> list[Caps]:
    """Codes whose caps hold a share ``cap_rows / rows`` of random vectors, so many that each vector falls into ``filters`` of each.

    A cap is never smaller than what two vectors at the threshold need to share it.
    """
    if dim == 1:
        return [Caps(np.eye(1), [np.array([[1.0], [-1.0]])], 0.5)]
    parts = max(1, min(parts, dim // 4))
    angles = np.linspace(0, math.pi / 2, 20_001)
    shares = cap_share(dim, angles)
    angle = max(float(np.interp(max(cap_rows / max(rows, 1), 1e-12), shares, angles)), 1.5 * math.acos(cosine))
    words = max(2, math.ceil((filters / float(cap_share(dim, np.array([angle]))[0])) ** (1 / parts)))
    out = []
    for code in range(codes):
        rng = np.random.default_rng((seed, code))
        basis, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        books = []
        for block in np.array_split(np.arange(dim), parts):
            book = rng.standard_normal((words, len(block)))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(len(block) / dim))
        out.append(Caps(basis, books, math.cos(angle)))
    return out


def decode(caps: Caps, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of all filters that each unit vector exceeds, by pruned enumeration."""
    turned = vectors @ caps.basis
    parts = np.array_split(np.arange(vectors.shape[1]), len(caps.books))
    gains = [turned[:, p] @ book.T for p, book in zip(parts, caps.books, strict=True)]
    rest = np.zeros((len(caps.books) + 1, len(vectors)))
    for k in range(len(gains) - 1, -1, -1):
        rest[k] = rest[k + 1] + gains[k].max(axis=1)
    rows, codes, sums = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for k, gain in enumerate(gains):
        ahead = sums[:, None] + gain[rows]
        at, word = np.nonzero(ahead + rest[k + 1][rows][:, None] >= caps.least)
        rows, codes, sums = rows[at], codes[at] * gain.shape[1] + word, ahead[at, word]
    return rows, codes


def decode_all(codes: list[Caps], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` over all codes; the filters of different codes are different."""
    found = [decode(caps, vectors) for caps in codes]
    return np.concatenate([r for r, _ in found]), np.concatenate([c * len(codes) + k for k, (_, c) in enumerate(found)])


def most_different(cosine: float, bits: int = BITS) -> int:
    """Differing signs over which a pair at the threshold is six deviations off."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def signs(vectors: np.ndarray, seed: int = 23) -> np.ndarray:
    """``BITS`` signs of random projections of each vector, as two longs."""
    turned = vectors @ np.random.default_rng((seed, vectors.shape[1])).standard_normal((vectors.shape[1], BITS)) > 0
    return np.packbits(turned, axis=1).view(np.uint64)


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16) <= most


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Forests of the members of each filter (a block pair of it) that may be linked; the rows come sorted by filter."""
    held: list[pa.Table] = []

    def forest(small: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The same for many small filters at once: rows at a distance d are compared where they are of one filter."""
        cap, node = small.column("cap").to_numpy(), small.column("node").to_numpy()
        sig = np.column_stack([small.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64)
        first, second = [], []
        at = np.arange(len(cap) - 1)
        for d in range(1, SMALL):
            at = at[at + d < len(cap)]
            at = at[cap[at] == cap[at + d]]
            if not len(at):
                break
            hit = at[_close(sig[at], sig[at + d], most)]
            first.append(hit)
            second.append(hit + d)
        if not first:
            return node[:0], node[:0]
        i, j = np.concatenate(first), np.concatenate(second)
        label = reached(len(cap), np.concatenate([i, j]), np.concatenate([j, i]))
        other = np.flatnonzero(label != np.arange(len(cap)))
        return node[other], node[label[other]]

    def large(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.column_stack([table.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64)
        near = _close(sig[:, None, :], sig[None, :, :], most)
        if across(table):
            own = table.column("own").to_numpy()
            near &= own[:, None] != own[None, :]
        node, label = table.column("node").to_numpy(), labelled(near)
        other = np.flatnonzero(label != np.arange(len(node)))
        return node[other], node[label[other]]

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        # Vectors that are near share many filters; their edge leaves a batch once.
        edges = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    rows = 0
    for table in grouped(batches, ["cap", "bi", "bj"]):
        if len(table) < 2:
            continue
        if len(table) > SMALL or table.column("bj")[0].as_py():
            yield out(*large(table))
            continue
        held.append(table)
        rows += len(table)
        if rows >= TOGETHER:
            yield out(*forest(pa.concat_tables(held)))
            held, rows = [], 0
    if held:
        yield out(*forest(pa.concat_tables(held)))


def units(column: pa.ListArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors of a column, and their components in a row; each vector is divided by its norm."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begins = np.cumsum(sizes) - sizes
    top = np.maximum.reduceat(np.abs(flat), begins) if len(begins) else flat
    flat = flat / np.repeat(top, sizes)
    norm = np.sqrt(np.add.reduceat(flat * flat, begins)) if len(begins) else flat
    return sizes, flat / np.repeat(norm, sizes)


def _verified(table: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links of a block pair of a group, in double precision: for each vector its links, counted in ids, and a forest edge."""
    node = table.column("node").to_numpy()
    _, rows = np.unique(node, return_index=True)  # a row repeated in the input is one vector
    if len(rows) < 2:
        return None
    table = table.take(rows)
    node, own, copies = (table.column(c).to_numpy() for c in ("node", "own", "copies"))
    x = units(table.column("embedding").combine_chunks())[1].reshape(len(node), -1)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if across(table):
        near &= own[:, None] != own[None, :]
    links, label = near @ copies, labelled(near)
    keep = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep].astype(np.int64)), pa.array(node[label[keep]])], ["node", "links", "peer"])


def usable(vectors: DataFrame) -> DataFrame:
    """``(id, k1, k2, embedding)`` of the vectors that can be linked, each with two hashes of its components."""
    kind = vectors.schema["embedding"].dataType.elementType
    whole = F.col("embedding") if isinstance(kind, (FloatType, DoubleType)) else F.col("embedding").cast("array<double>")
    good = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), whole.alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    good = good.where(F.size("embedding") > 0).where(finite).where(F.exists("embedding", lambda c: c != 0))
    return good.select("id", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(0x5EED), "embedding").alias("k2"), "embedding")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, parts: int = PARTS, codes: int = CODES, filters: int = FILTERS, cap_rows: int = CAP_ROWS) -> Linked:
    """The links of a cosine of at least ``cosine`` among the vectors of ``vectors (vec_id, embedding)``."""
    scratch = Scratch(vectors.sparkSession, "near-vectors")
    good = usable(vectors)
    rows = good.select("id", "k1", "k2")
    nodes = numbered_contents(rows, scratch)
    shapes = good.groupBy(F.size("embedding").alias("dim")).count().collect()
    plans = {r["dim"]: plan_caps(r["dim"], r["count"], cosine, parts, codes, filters, cap_rows) for r in shapes}
    if (nodes.agg(F.sum("copies").alias("n")).first()["n"] or 0) < sum(r["count"] for r in shapes):
        rows = scratch.keep(rows.distinct(), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, flat = units(batch.column(1))
            begins = np.cumsum(sizes) - sizes
            for dim, caps in plans.items():
                here = np.flatnonzero(sizes == dim)
                if not len(here):
                    continue
                x = flat[begins[here][:, None] + np.arange(dim)[None, :]]
                at, own = decode_all(caps, x)
                # Filters of another length of vector are others.
                own = own * 65536 + dim % 65536
                order = np.argsort(at, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(here)))]).astype(np.int32)), pa.array(own[order]))
                sig = signs(x).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(here)), pa.array(sig[:, 0]), pa.array(sig[:, 1]), lists], ["node", "s1", "s2", "caps"])

    # Where the content is another's copy, its smallest id stands for it.
    firsts = good.join(nodes.select("k1", "k2", F.col("low").alias("id"), "node"), ["k1", "k2", "id"])
    decoded = scratch.keep(firsts.select("node", "embedding").mapInArrow(run, "node long, s1 long, s2 long, caps array<long>"), "decoded")
    spread = decoded.select(F.explode("caps").alias("cap"), "node", "s1", "s2")
    counts = spread.groupBy("cap").agg(F.count("*").alias("members"))
    # Filters of a chance size are whole blocks; only larger ones are dealt, so only those need their number of members.
    heavy = scratch.keep(counts.where(F.col("members") > BLOCK_ROWS), "heavy")
    inside = spread.join(heavy, "cap", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    inside = dealt(inside, "cap", "node", F.ceil(F.col("members") / BLOCK_ROWS)).select("cap", "bi", "bj", "own", "node", "s1", "s2")
    most = most_different(cosine)
    edges = inside.repartition("cap", "bi", "bj").sortWithinPartitions("cap", "bi", "bj").mapInArrow(lambda b: _candidates(b, most), "u long, v long")
    groups = components(edges, scratch)

    groups = groups.join(nodes, "node").select("node", F.col("component").alias("gid"), "copies", "k1", "k2", F.col("low").alias("id"))
    groups = scratch.keep(groups, "groups")
    sizes = groups.groupBy("gid").agg(F.count("*").alias("members"))
    members = good.join(groups, ["k1", "k2", "id"]).join(sizes, "gid")
    members = dealt(members, "gid", "node", F.ceil(F.col("members") / BLOCK_ROWS)).select("gid", "bi", "bj", "own", "node", "copies", "embedding")
    links = in_groups(members, ["gid", "bi", "bj"], lambda t: _verified(t, cosine), "node long, links long, peer long")
    links = scratch.keep(links, "links")
    scratch.only(rows, nodes, links)
    return Linked(rows, nodes, links, scratch)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, parts: int = PARTS, codes: int = CODES, filters: int = FILTERS, cap_rows: int = CAP_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of the vectors that have links."""
    found = linked_vectors(vectors, cosine, parts, codes, filters, cap_rows).by_id()
    return found.where("n_links > 0").select(F.col("id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = near_vectors(vectors)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    component = F.coalesce("component_id", "vec_id")
    return ids.join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(embedding, lambda c: abs(c))) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT m.a AS vec_id, (SELECT count(*) FROM e WHERE e.a = m.a)::BIGINT AS n_links, c AS component_id, m.a = c AS kept FROM m
"""
