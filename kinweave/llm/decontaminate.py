"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a window of ``SPAN`` tokens of which a fixed mask keeps some and
ignores the others, so windows that differ at ignored positions hash alike.
All windows of the benchmark are hashed under every mask, and so are those of
the training texts; both are joined on the hash. Around each hit the aligned
tokens, up to ``MARGIN`` to either side of the window and inside both texts,
are compared: any overlap that holds the window, has at least ``MIN_OVERLAP``
tokens and at least ``MIN_EQUAL`` of them equal counts, so a passage may begin
and end anywhere in both texts. The best overlap of a pair is then followed to
the right and to the left as far as that share of equal tokens holds.
Substituted tokens are tolerated, inserted or missing ones end an overlap.

Tokens are maximal runs of letters and digits, lower-cased. The seeds of the
benchmark are counted first. Up to ``MAX_BROADCAST`` they are broadcast. More
are taken in parts of ``PART`` seeds: a bitmap of a part's seeds, of bounded
size, leaves few windows of the texts, and those are shuffled as a seed, a key
of their text and a position, with the same result.

Defined cases: null or empty texts and texts shorter than a window overlap
with nothing, items with fewer than ``MIN_OVERLAP`` tokens neither; repeated
rows give repeated hits that are one pair, and of several texts of an id the
best overlap counts; null ids make pairs with null ids; an empty benchmark or
table gives no pairs; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

SPAN = 12
#: Offsets that each mask keeps; together they find all 13-token overlaps with two substitutions, 99.8 % of 15 with three and 99.95 % of 20 with four.
MASKS = ((0, 1, 2, 6, 8, 11), (0, 2, 3, 4, 5, 10), (0, 4, 7, 8, 9, 11), (1, 4, 6, 7, 10, 11))
MARGIN = 4
MIN_OVERLAP, MIN_EQUAL = 13, 0.8
#: Seeds of the benchmark (of about 40 bytes) that are broadcast at most.
MAX_BROADCAST = 1_000_000
#: Seeds of a part of a larger benchmark, and bits of its bitmap (as a power of two: 16 MB).
PART, BITS = 1 << 23, 27


def tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.split(bare, r"[^\p{L}\p{N}]+", -1)


def _seeds(df: DataFrame, at: str) -> DataFrame:
    """One row for each window and mask of the hash array ``h``: its begin ``at`` and its ``seed``."""
    n = F.size("h")
    every = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.expr("cast(array() as array<int>)"))
    windows = df.withColumn(at, F.explode(every))
    # The number of the mask is part of what is hashed.
    hashes = [F.xxhash64(F.lit(k), *[F.get("h", F.col(at) + o) for o in mask]) for k, mask in enumerate(MASKS)]
    # A projection of its own shares the tokens among the masks, which an argument of explode does not.
    return windows.withColumn("_seeds", F.array(*hashes)).withColumn("seed", F.explode("_seeds")).drop("_seeds")


def _hashes(text: str) -> Column:
    return F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t))


def _bitmap(seeds: DataFrame, bits: int) -> Column:
    """The last ``bits`` bits of all ``seed`` values as a set: an array of longs, for a scalar subquery."""
    words = 1 << (bits - 6)
    place = F.expr(f"shiftright(seed & {(1 << bits) - 1}L, 6)")
    held = seeds.groupBy(place.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("word"))
    every = seeds.sparkSession.range(words).join(held, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words")).scalar()


def _hits(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, version, h, doc_pos, item_id, item_key, item_h, item_pos)`` of windows that hash alike under a mask."""
    texts = items.dropDuplicates(["item_key"]).select("item_key", F.col("h").alias("item_h"))
    hashed = docs.select("doc_id", _hashes("text").alias("h"))
    count = (items.agg(F.sum(F.size("h").cast("long")).alias("n")).first()["n"] or 0) * len(MASKS)
    if count <= MAX_BROADCAST:
        seeds = F.broadcast(_seeds(items, "item_pos").select("seed", "item_id", "item_key", "item_pos"))
        hits = _seeds(hashed, "doc_pos").join(seeds, "seed").join(F.broadcast(texts), "item_key")
        return hits.withColumn("version", F.xxhash64("h"))
    items = scratch.keep(items, "items")
    parts = -(-count // PART)
    bits = min(BITS, max(10, (16 * min(count, PART)).bit_length()))
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_key", F.lit(8)), F.lit(parts)) == part)
        seeds = scratch.keep(_seeds(own, "item_pos").select("seed", "item_id", "item_key", "item_pos"), "seeds")
        word = F.get(_bitmap(seeds, bits), F.expr(f"cast(shiftright(seed & {(1 << bits) - 1}L, 6) as int)"))
        spread = _seeds(hashed.withColumn("version", F.xxhash64("h")), "doc_pos").select("seed", "doc_id", "version", "doc_pos")
        spread = spread.where(word.bitwiseAND(F.expr("shiftleft(1L, cast(seed & 63 as int))")) != 0)
        joined = spread.join(seeds, "seed").select("doc_id", "version", "doc_pos", "item_id", "item_key", "item_pos").distinct()
        found = joined if found is None else found.unionByName(joined)
    found = scratch.keep(found, "hits")
    return _with_texts(found, docs).join(texts, "item_key")


def _with_texts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found (doc_id, version, ...)`` with the token hashes ``h`` of that text; only documents found are hashed again."""
    ids = found.select(F.col("doc_id").alias("_kw_id")).distinct()
    near = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_kw_id")), "left_semi")
    near = near.select(F.col("doc_id").alias("_kw_id"), _hashes("text").alias("h")).withColumn("_kw_version", F.xxhash64("h")).dropDuplicates(["_kw_id", "_kw_version"])
    return found.join(near, F.col("doc_id").eqNullSafe(F.col("_kw_id")) & (F.col("version") == F.col("_kw_version"))).drop("_kw_id", "_kw_version")


def _windows(hits: DataFrame) -> DataFrame:
    """``(doc_id, item_id, b)``: the best overlap near the hits of each pair."""
    left = F.least(F.col("doc_pos"), F.col("item_pos"), F.lit(MARGIN))
    right = F.least(F.size("h") - F.col("doc_pos"), F.size("item_h") - F.col("item_pos"), F.lit(SPAN + MARGIN)) - SPAN
    hits = hits.withColumn("left", left).withColumn("right", right)
    n = F.col("left") + SPAN + F.col("right")
    same = F.transform(
        F.arrays_zip(
            F.slice("h", F.col("doc_pos") - F.col("left") + 1, n).alias("a"),
            F.slice("item_h", F.col("item_pos") - F.col("left") + 1, n).alias("b"),
        ),
        lambda x: x["a"] == x["b"],
    )
    # No part of a neighbourhood with fewer equal tokens can hold an overlap.
    hits = hits.withColumn("same", same).where(F.size(F.filter("same", lambda x: x)) >= F.lit(MIN_OVERLAP * MIN_EQUAL))

    def window(before: Column, after: Column) -> Column:
        inside = F.slice("same", F.col("left") - before + 1, before + SPAN + after)
        return F.struct(
            F.size(F.filter(inside, lambda x: x)).alias("n_equal"), F.size(inside).alias("n_tokens"), (before - F.col("doc_pos")).alias("d"), (before - F.col("item_pos")).alias("i")
        )

    steps = lambda c: F.sequence(F.lit(0), F.col(c))
    windows = F.flatten(F.transform(steps("left"), lambda x: F.transform(steps("right"), lambda y: window(x, y))))
    enough = F.filter(windows, lambda w: (w["n_tokens"] >= MIN_OVERLAP) & (w["n_equal"] >= w["n_tokens"] * F.lit(MIN_EQUAL)))
    found = hits.select("doc_id", "item_id", "version", "item_key", F.array_max(enough).alias("w")).where("w is not null")
    best = F.max(F.struct("w.n_equal", "w.n_tokens", "w.d", "w.i", "version", "item_key"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b"))


def _followed(same: Callable[[Column], Column], most: Column, equal: Column, size: Column) -> Column:
    """``(more, equal)``: by how many tokens an overlap can grow to one side, ending in an equal one, and its equal tokens then."""
    start = F.struct(F.lit(0).alias("more"), equal.alias("equal"), equal.alias("seen"))

    def step(acc: Column, k: Column) -> Column:
        seen = acc["seen"] + same(k).cast("int")
        holds = same(k) & (seen >= (size + k) * F.lit(MIN_EQUAL))
        return F.struct(F.when(holds, k).otherwise(acc["more"]).alias("more"), F.when(holds, seen).otherwise(acc["equal"]).alias("equal"), seen.alias("seen"))

    places = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(places, start, step, lambda acc: F.struct(acc["more"].alias("more"), acc["equal"].alias("equal")))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_equal, n_tokens, doc_at, item_at)``: the best overlap of each contaminated pair.

    ``doc_at`` and ``item_at`` are the token positions at which it begins.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = _items(benchmark)
    best = _windows(_hits(docs, items, scratch)).select(
        "doc_id", "item_id", "b.version", "b.item_key", "b.n_equal", "b.n_tokens", (-F.col("b.d")).alias("doc_at"), (-F.col("b.i")).alias("item_at")
    )
    best = scratch.keep(best, "best")
    texts = items.dropDuplicates(["item_key"]).select("item_key", F.col("h").alias("item_h"))
    pairs = _with_texts(best, docs).join(texts, "item_key")
    ends = [F.col(c) + F.col("n_tokens") for c in ("doc_at", "item_at")]
    after = F.least(F.size("h") - ends[0], F.size("item_h") - ends[1])
    right = _followed(lambda k: F.get("h", ends[0] + k - 1) == F.get("item_h", ends[1] + k - 1), after, F.col("n_equal"), F.col("n_tokens"))
    pairs = pairs.withColumn("r", right)
    before = F.least("doc_at", "item_at")
    left = _followed(lambda k: F.get("h", F.col("doc_at") - k) == F.get("item_h", F.col("item_at") - k), before, F.col("r.equal"), F.col("n_tokens") + F.col("r.more"))
    pairs = pairs.withColumn("l", left)
    long = lambda c: c.cast("long")
    return pairs.select(
        "doc_id",
        "item_id",
        long(F.col("l.equal")).alias("n_equal"),
        long(F.col("n_tokens") + F.col("r.more") + F.col("l.more")).alias("n_tokens"),
        long(F.col("doc_at") - F.col("l.more")).alias("doc_at"),
        long(F.col("item_at") - F.col("l.more")).alias("item_at"),
    )


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", _hashes("text").alias("h")).where(F.size("h") >= MIN_OVERLAP)
    return items.withColumn("item_key", F.xxhash64("h"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap with a benchmark item."""
    hits = _hits(docs.select("doc_id", "text"), _items(benchmark), Scratch(docs.sparkSession, "decontaminate"))
    bad = _windows(hits).select(F.col("doc_id").alias("_kw_id")).distinct()
    return docs.join(bad, docs["doc_id"] == F.col("_kw_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    keys = " UNION ALL ".join(
        f"SELECT id, n, p, {k} AS mask, concat_ws(' ', {', '.join(f't[p + {o + 1}]' for o in mask)}) AS seed FROM w" for k, mask in enumerate(MASKS)
    )

    def side(name: str, table: str, key: str, least: int) -> str:
        return f"""{name}t AS (SELECT {key} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {table}),
{name} AS (WITH w AS (SELECT id, t, len(t) AS n, unnest(range(0, len(t) - {SPAN} + 1)) AS p FROM {name}t WHERE len(t) >= {least}) {keys})"""

    return f"""
WITH {side("d", "documents", "doc_id", SPAN)}, {side("b", "benchmark", "item_id", MIN_OVERLAP)},
hit AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.p AS dp, b.p AS bp, d.n AS dn, b.n AS bn FROM d JOIN b ON d.mask = b.mask AND d.seed = b.seed),
r AS (SELECT *, least(dp, bp, {MARGIN}) AS l, least(dn - dp, bn - bp, {SPAN + MARGIN}) + least(dp, bp, {MARGIN}) AS n FROM hit),
e AS (SELECT r.doc_id, r.item_id, r.n, dp - l AS da, bp - l AS ba,
  len(list_filter(range(0, r.n), lambda i: dt.t[dp - l + i + 1] = bt.t[bp - l + i + 1])) AS eq
  FROM r JOIN dt ON dt.id = r.doc_id JOIN bt ON bt.id = r.item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY eq DESC, n DESC, da, ba) AS o FROM e WHERE n >= {MIN_OVERLAP} AND eq >= n * {MIN_EQUAL}),
x AS (SELECT k.*,
  list_transform(range(0, least(len(dt.t) - da - n, len(bt.t) - ba - n)), lambda i: CASE WHEN dt.t[da + n + i + 1] = bt.t[ba + n + i + 1] THEN 1 ELSE 0 END) AS r,
  list_transform(range(0, least(da, ba)), lambda i: CASE WHEN dt.t[da - i] = bt.t[ba - i] THEN 1 ELSE 0 END) AS l
  FROM k JOIN dt ON dt.id = k.doc_id JOIN bt ON bt.id = k.item_id WHERE o = 1),
y AS (SELECT *, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda q: r[q] = 1 AND eq + list_sum(r[1:q]) >= (n + q) * {MIN_EQUAL})), 0) AS p FROM x),
z AS (SELECT *, eq + coalesce(list_sum(r[1:p]), 0) AS e2, n + p AS n2 FROM y),
u AS (SELECT *, coalesce(list_max(list_filter(range(1, len(l) + 1), lambda q: l[q] = 1 AND e2 + list_sum(l[1:q]) >= (n2 + q) * {MIN_EQUAL})), 0) AS s FROM z)
SELECT doc_id, item_id, (e2 + coalesce(list_sum(l[1:s]), 0))::BIGINT AS n_equal, (n2 + s)::BIGINT AS n_tokens, (da - s)::BIGINT AS doc_at, (ba - s)::BIGINT AS item_at FROM u
"""


ORACLE = _oracle()
