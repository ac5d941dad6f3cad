"""Line deduplication over levelled sorted runs of line hashes.

The index is a set of runs, each a Parquet table of line keys sorted by hash.
A batch of documents is merge-joined against the runs: keys in no run are new
and become the batch's own run, keys in a run belong to an earlier batch. When
a level holds ``fanout`` runs they are merged into one run of the next level,
so a key is rewritten once a level and a batch reads few runs.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends
and with A-Z lower-cased; it is held as two 64-bit hashes. Keys of fewer than
``min_chars`` code points are never duplicates.

Defined cases: null or empty text is one empty line; rows with a null id keep
all their lines and index none; repeated ids count as one document, whatever
their texts; ids may be any 64-bit numbers; an empty table gives an empty
table; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

BLANKS = " \t\n\x0b\x0c\r"
#: Code points below which a key is never a duplicate.
MIN_CHARS = 10
#: Batches in which a whole table is taken in, and runs a level holds before they are merged.
BATCHES, FANOUT = 4, 2


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def lines_of(text: Column) -> Column:
    """All lines of a text, in order."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5EED), key).alias("h2")]


class LineRuns:
    """Line keys seen so far, each with the smallest document of the batch that brought it."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(spark, "line-runs")
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, keys: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep(keys.repartition("h1").sortWithinPartitions("h1", "h2"), name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for run in level[1:]:
                    merged = merged.unionByName(run)
                merged = self._sorted(merged, f"level{k + 1}")
                self.scratch.drop(*level)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in ``lines (h1, h2, doc_id)``; return ``(h1, h2, doc_id)`` of the lines that are not their key's first.

        A key's first document is that of the run that holds it, else the
        smallest of the batch.
        """
        self.compact()
        here = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        runs = self.runs()
        if runs:
            seen = runs[0]
            for run in runs[1:]:
                seen = seen.unionByName(run)
            here = here.join(seen.select("h1", "h2", F.col("first").alias("before")), ["h1", "h2"], "left")
        else:
            here = here.withColumn("before", F.lit(None).cast("long"))
        here = self.scratch.keep(here, "batch")
        fresh = here.where("before is null").select("h1", "h2", F.col("low").alias("first"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._sorted(fresh, "level0"))
        again = here.select("h1", "h2", F.coalesce("before", "low").alias("first"), "high").where("high <> first")
        return lines.join(again.select("h1", "h2", "first"), ["h1", "h2"]).where("doc_id <> first").drop("first")


def ranges(docs: DataFrame, batches: int) -> Column:
    """The batch of each document: ranges of ascending ids that hold about as many rows each."""
    shares = F.lit([k / batches for k in range(1, batches)])
    ends = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000).alias("q")).first()["q"] if batches > 1 else None
    batch = F.lit(0)
    for end in sorted(set(ends or ())):
        batch = batch + (F.col("doc_id") > F.lit(end)).cast("int")
    return batch


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, version, gone)``: for each document text that loses lines, their numbers from 0.

    ``version`` is the hash of the text, which tells several texts of one id apart.

    The documents are taken in as ``batches`` ranges of ids in ascending order,
    so the document that keeps a key's lines is the smallest that holds it.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-runs")
    keys = F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("line", "key")
    lines = (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("version"), "text")
        .select("doc_id", "version", keys)
        .where(F.length("key") >= min_chars)
        .select(*hashed(F.col("key")), "doc_id", "version", "line", ranges(docs, batches).alias("batch"))
    )
    lines = scratch.keep(lines, "lines")
    index = LineRuns(spark, fanout, scratch)
    gone = None
    for k in range(batches):
        part = index.add(lines.where(F.col("batch") == k).drop("batch"))
        gone = part if gone is None else gone.unionByName(part)
    scratch.drop(*index.runs())
    return gone.groupBy("doc_id", "version").agg(F.collect_set("line").alias("gone"))


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs (doc_id, text, ...)`` with the text that remains, and ``n_lines``, ``n_dropped``.

    Other columns stay as they are.
    """
    gone = duplicate_lines(docs.select("doc_id", "text"), min_chars, batches, fanout)
    gone = gone.select(F.col("doc_id").alias("_kw_id"), F.col("version").alias("_kw_version"), F.col("gone").alias("_kw_gone"))
    both = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_kw_id")) & (version(F.col("text")) == F.col("_kw_version")), "left")
    lines = lines_of(F.col("text"))
    both = both.withColumn("_kw_lines", F.size(lines))
    # Numbers of the lines that stay, found by hashing: in proportion to the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.col("_kw_lines") - 1), F.col("_kw_gone"))
    text = F.when(F.col("_kw_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(_taken(lines, stay))
    return both.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.col("_kw_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_kw_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _taken(lines: Column, numbers: Column) -> Column:
    """Chosen lines, joined; the lines are split once."""
    both = F.array(F.struct(lines.alias("lines"), numbers.alias("numbers")))
    return F.transform(both, lambda b: F.array_join(F.transform(b["numbers"], lambda k: F.get(b["lines"], k)), "\n"))[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, unnest(range(len(d.ls))) AS i) u),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.i, l.line, (f.k IS NOT NULL AND l.doc_id <> f.first) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
