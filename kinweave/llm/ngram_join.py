"""N-gram Jaccard join: MinHash banding, then the full n-gram sets.

1. Each text becomes the set of hashes of its word 5-grams (see ``text``).
   Texts with the same words in the same order are copies: the smallest id
   represents them, and copies are never expanded into pairs.
2. ``rows * bands`` minima are taken of each representative's set, with the
   numbers chosen for the target recall at the threshold. The hash of a band
   is a bucket; buckets with one member go.
3. Inside each bucket the members' signatures are compared, and members that
   may reach the threshold are joined to a group. A bucket over the block
   budget is dealt into blocks, each pair of blocks is a task of its own, and
   only a spanning forest leaves a task, never all pairs.
4. The groups' full n-gram sets are compared block by block. What leaves a
   task is each document's number of links and a spanning forest of the links;
   so no link between different texts is lost, none is a row.

A pair at the threshold is missed only if no band agrees (``RECALL``).

What is linked are texts, whatever their ids; ids come in at the end. So an id
with several texts loses none of them: it has the links of all its texts, and
where one document of each class is kept, rows go, not ids.

Defined cases: texts with fewer than five words but at least one have one gram,
all their words; texts without words, null ones too, are copies of each other
and link with no other text; null ids link with nothing; a repeated row is one
document, and so are the texts of one id (links among them count too); an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .links import Linked, across, components, dealt, in_groups, labelled, numbered_contents
from .shared import Scratch
from .text import gram_hashes, mix, slices, words_of

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Signatures and n-grams of a block of a group.
BLOCK_ROWS, BLOCK_GRAMS = 1024, 400_000
#: Columns of a block's incidence matrix that are multiplied at once.
BLOCK_COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band, so the fewest chance candidates, for the recall at the threshold within ``most`` minima."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def least_agreement(minima: int, threshold: float) -> int:
    """Equal minima below which a pair at the threshold is five deviations off."""
    return max(0, math.floor(minima * threshold - 5 * math.sqrt(minima * threshold * (1 - threshold))))


def _coefficients(minima: int) -> tuple[np.ndarray, np.ndarray]:
    draws = mix(np.arange(1, 2 * minima + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return (draws[:minima] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draws[minima:] >> np.uint64(32)).astype(np.uint32)


def minima_of(grams: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """The minimum of each hash function over a set of grams."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.uint32(0xFFFFFFFF), np.uint32)
    for k in range(0, len(x), step):
        part = np.multiply.outer(x[k : k + step], a)
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    return low


def sequence_keys(hashes: np.ndarray) -> np.ndarray:
    """128 bits of a sequence of words, as two longs."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    one, two = np.sum(mix(hashes + place * np.uint64(0x9E3779B97F4A7C15))), np.sum(mix(hashes ^ mix(place)))
    return np.array([one, two], np.uint64).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """``(doc_id, k1, k2, grams, bands, sig)`` of each text: 128 bits of its word sequence, number of grams, band hashes, a byte of each minimum."""
    a, b = _coefficients(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                words = words_of(part.column(1))
                grams, at = gram_hashes(words, n)
                low = np.zeros((part.num_rows, bands * rows), np.uint32)
                keys = np.empty((2, part.num_rows), np.int64)
                for r in range(part.num_rows):
                    if at[r + 1] > at[r]:
                        low[r] = minima_of(grams[at[r] : at[r + 1]], a, b)
                    keys[:, r] = sequence_keys(words.hashes[words.at[r] : words.at[r + 1]])
                band = np.zeros((part.num_rows, bands), np.uint64)
                for k in range(rows):
                    band = mix(band + low[:, k::rows].astype(np.uint64) + np.uint64(k + 1))
                band = mix(band + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.reshape(-1).view(np.int64)))
                sig = [row.tobytes() for row in (low & np.uint32(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(np.diff(at).astype(np.int64)),
                        lists,
                        pa.array(sig, pa.binary()),
                    ],
                    ["doc_id", "k1", "k2", "grams", "bands", "sig"],
                )

    chosen = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, k1 long, k2 long, grams long, bands array<long>, sig binary")


def _forest(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each row to the first row it reaches."""
    label = labelled(near)
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _agreeing(table: pa.Table, least: int) -> pa.RecordBatch | None:
    """Which members of a block pair of a bucket may be near: a forest."""
    n = len(table)
    if n < 2:
        return None
    ids, own = table.column("node").to_numpy(), table.column("own").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    if n == 2:
        if ids[0] == ids[1] or np.count_nonzero(sig[0] == sig[1]) < least:
            return None
        u, v = ids[:1], ids[1:]
    else:
        same = np.zeros((n, n), np.uint16)
        for k in range(sig.shape[1]):
            c = sig[:, k]
            same += c[:, None] == c[None, :]
        near = same >= least
        if across(table):
            near &= own[:, None] != own[None, :]
        u, v = _forest(ids, near)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _verified(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links of a block pair of a group by the full sets: for each row its links, and a forest edge."""
    _, rows = np.unique(table.column("node").to_numpy(), return_index=True)  # a row repeated in the input is one document
    table = table.take(rows)
    n = len(table)
    if n < 2:
        return None
    ids, own = table.column("node").to_numpy(), table.column("own").to_numpy()
    copies = table.column("copies").to_numpy()
    sets = [np.frombuffer(x, np.int64) for x in table.column("set").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared_by = np.array([[0, shared], [shared, 0]], np.float64)
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(n), sizes)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count[column] > 1
        place = np.cumsum(count > 1) - 1
        row, column = row[several], place[column[several]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        shared_by = np.zeros((n, n), np.float64)
        for begin in range(0, width, BLOCK_COLUMNS):
            lo, hi = np.searchsorted(column, [begin, begin + BLOCK_COLUMNS])
            part = np.zeros((n, min(BLOCK_COLUMNS, width - begin)), np.float32)
            part[row[lo:hi], column[lo:hi] - begin] = 1
            shared_by += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared_by
    near = shared_by >= threshold * union - 1e-9
    np.fill_diagonal(near, False)
    near &= ids[:, None] != ids[None, :]
    if across(table):
        near &= own[:, None] != own[None, :]
    links = near @ copies
    label = labelled(near)
    keep = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep].astype(np.int64)), pa.array(ids[label[keep]])], ["node", "links", "peer"])


def _gram_sets(members: DataFrame, n: int) -> DataFrame:
    """``members (node, gid, copies, k1, k2, text)`` with the sorted distinct gram hashes of each whose words have these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(5)):
                part = batch.slice(begin, end - begin)
                words = words_of(part.column(5))
                grams, at = gram_hashes(words, n)
                keys = np.column_stack([part.column(3).to_numpy(), part.column(4).to_numpy()])
                rows = [r for r in range(part.num_rows) if np.array_equal(sequence_keys(words.hashes[words.at[r] : words.at[r + 1]]), keys[r])]
                sets = [np.unique(grams[at[r] : at[r + 1]].view(np.int64)) for r in rows]
                taken = [part.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "gid", "copies", "set"])

    return members.select("node", "gid", "copies", "k1", "k2", "text").mapInArrow(run, "node long, gid long, copies long, set binary")


def linked_texts(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> Linked:
    """The links of Jaccard similarity of at least ``threshold`` among the texts of ``docs (doc_id, text)``."""
    bands, rows = choose_bands(threshold, recall)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    signed = scratch.keep(signatures(docs, bands, rows, n), "signed")
    keyed = signed.select(F.col("doc_id").alias("id"), "k1", "k2")
    nodes = numbered_contents(keyed, scratch)
    pairs = nodes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    firsts = signed.join(nodes.select("k1", "k2", F.col("low").alias("doc_id"), "node", "copies"), ["k1", "k2", "doc_id"])
    if pairs < signed.count():
        keyed = scratch.keep(keyed.distinct(), "rows")
        firsts = firsts.dropDuplicates(["k1", "k2", "doc_id"])
    firsts = scratch.keep(firsts.select("node", "doc_id", "copies", "grams", "bands", "sig", "k1", "k2"), "firsts")

    spread = firsts.where("grams > 0").select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    inside = spread.join(buckets, "bucket").join(firsts.select("node", "sig"), "node")
    inside = dealt(inside, "bucket", "node", F.ceil(F.col("members") / BLOCK_ROWS))
    least = least_agreement(bands * rows, threshold)
    inside = inside.select("bucket", "bi", "bj", "own", "node", "sig")
    edges = in_groups(inside, ["bucket", "bi", "bj"], lambda t: _agreeing(t, least), "u long, v long")
    groups = components(edges, scratch)

    groups = groups.join(firsts.select("node", "doc_id", "copies", "grams", "k1", "k2"), "node").withColumnRenamed("component", "gid")
    groups = scratch.keep(groups, "groups")
    sizes = groups.groupBy("gid").agg(F.sum("grams").alias("all_grams"), F.count("*").alias("all_rows"))
    # Members can be a share of all documents: texts are shuffled once at every size.
    chosen = groups.select("node", "doc_id", "gid", "copies", "k1", "k2").hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    members = _gram_sets(texts, n).join(sizes, "gid")
    blocks = F.greatest(F.ceil(F.col("all_grams") / BLOCK_GRAMS), F.ceil(F.col("all_rows") / BLOCK_ROWS))
    members = dealt(members, "gid", "node", blocks).select("gid", "bi", "bj", "own", "node", "copies", "set")
    links = in_groups(members, ["gid", "bi", "bj"], lambda t: _verified(t, threshold), "node long, links long, peer long")
    links = scratch.keep(links, "links")
    scratch.only(signed, keyed, nodes, links)
    return Linked(keyed, nodes, links, scratch)


def join_documents(docs: DataFrame) -> DataFrame:
    """One row a document id: ``(doc_id, class_id, copy_of, n_links)``; alone, a document is its own class.

    ``copy_of`` is the smallest document with the same words in the same order;
    ``class_id`` the smallest document reachable by copies and links;
    ``n_links`` the number of other documents with a Jaccard similarity of at
    least the threshold, copies included.
    """
    found = linked_texts(docs.select("doc_id", "text")).by_id().withColumnRenamed("id", "doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_kw_k1`` and ``_kw_k2``, the keys of their texts."""
    at, names = docs.columns.index("text"), [*docs.columns, "_kw_k1", "_kw_k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(at)):
                part = batch.slice(begin, end - begin)
                words = words_of(part.column(at))
                keys = np.array([sequence_keys(words.hashes[words.at[r] : words.at[r + 1]]) for r in range(part.num_rows)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_kw_k1", LongType()), StructField("_kw_k2", LongType())]))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id.

    Rows go, not ids: of an id with several texts those stay that are the first
    of their class. Repeated rows stay or go together.
    """
    linked = linked_texts(docs.select("doc_id", "text"))
    gone = linked.surplus().select(F.col("id").alias("_kw_id"), F.col("k1").alias("_kw_g1"), F.col("k2").alias("_kw_g2"))
    own = docs["doc_id"].cast("long")
    several = linked.several()
    if several is None:
        return docs.join(gone, own == F.col("_kw_id"), "left_anti")
    gone = linked.scratch.keep(gone, "gone")
    several = several.withColumnRenamed("id", "_kw_several")
    plain = docs.join(several, own == F.col("_kw_several"), "left_anti").join(gone, F.col("doc_id").cast("long") == F.col("_kw_id"), "left_anti")
    odd = _keyed(docs.join(several, own == F.col("_kw_several"), "left_semi"))
    same = (F.col("doc_id").cast("long") == F.col("_kw_id")) & (F.col("_kw_k1") == F.col("_kw_g1")) & (F.col("_kw_k2") == F.col("_kw_g2"))
    return plain.unionByName(odd.join(gone, same, "left_anti").drop("_kw_k1", "_kw_k2"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id
  UNION ALL SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
cp AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS copy_of FROM t)
SELECT t.doc_id, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS class_id, cp.copy_of,
  (SELECT count(*) FROM e WHERE e.x = t.doc_id)::BIGINT AS n_links
FROM t JOIN cp ON cp.doc_id = t.doc_id
"""
