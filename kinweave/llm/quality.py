"""Quality classifier: a regularised quadratic discriminant.

Statistics of the whole text (shares of character classes, words and lines) are
transformed to be nearer to normal. For each class the mean and a covariance,
shrunk towards the pooled one and towards its diagonal and held as its Cholesky
factor, are fitted once; a score is the logistic of the difference of the
classes' log densities, each a Mahalanobis distance by a triangular solve.

The fit takes at most ``SAMPLE`` labelled documents a class, chosen by a hash of
the id; the class shares are counted over all labelled rows. Scoring covers
every row and every character, with no shuffle.

Defined cases: null text reads as empty; an empty text is scored from its
statistics like any other; null ids pass through and are not held out; labels
that are null, other than 0 and 1, or of unknown documents teach nothing; a
document labelled twice counts twice, and one of several texts of an id (the
smallest) is fitted on; if a class has no labelled row, every
score is the share of label 1 (0.5 without labels); an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable
from .text import buffers, mix, slices, words_of

#: Labelled documents that a class is fitted on at most.
SAMPLE = 4000
#: Shares of the pooled covariance and of the diagonal in a class covariance.
POOLED, DIAGONAL = 0.2, 0.1
#: Score from which a document is predicted to be of quality.
CUT = 0.3

_LETTER, _UPPER, _DIGIT, _BLANK, _STOP, _BANG, _MARK, _TAIL, _BREAK = range(1, 10)


def _classes() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[[*range(97, 123), *range(0xC0, 256)]] = _LETTER
    kinds[list(range(65, 91))] = _UPPER
    kinds[list(range(48, 58))] = _DIGIT
    kinds[list(b" \t\r\x0b\x0c")] = _BLANK
    kinds[ord("\n")] = _BREAK
    kinds[list(b".,;:?'\"()-")] = _STOP
    kinds[ord("!")] = _BANG
    kinds[list(range(0x80, 0xC0))] = _TAIL
    return kinds


_KINDS = _classes()
FEATURES = ("upper", "digits", "stops", "bangs", "marks", "blank", "word", "short", "varied", "stutter", "line", "pairs")
#: Characters and words of usual text that every text is taken to have besides its own.
CHARS, WORDS = 100, 20


def _kinds_of(data: np.ndarray, at: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Numbers of bytes of each kind in each row."""
    rows, width = len(at) - 1, _BREAK + 1
    counts = np.zeros(rows * width)
    for begin in range(0, len(data), piece):
        end = min(begin + piece, len(data))
        lo, hi = np.searchsorted(at, begin, "right") - 1, np.searchsorted(at, end)
        row = np.repeat(np.arange(lo, hi), np.minimum(at[lo + 1 : hi + 1], end) - np.maximum(at[lo:hi], begin))
        counts += np.bincount(row * width + _KINDS[data[begin:end]], minlength=rows * width)
    return counts.reshape(rows, width)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, at = buffers(column)
    rows = len(at) - 1
    counts = _kinds_of(data, at)
    n_lines = counts[:, _BREAK] + 1
    counts[:, _BLANK] += counts[:, _BREAK]
    counts[:, _BREAK] = 0
    chars = np.maximum(counts.sum(axis=1) - counts[:, _TAIL], 0)
    words = words_of(column)
    n_words = np.diff(words.at).astype(float)
    row = np.repeat(np.arange(rows), np.diff(words.at))
    sizes = (words.ends - words.begins).astype(float)
    per_row = lambda x, r=row: np.bincount(r, x, rows)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Number of distinct hashes of each row."""
        if rows == 1:
            ordered = np.sort(hashes)
            return np.array([np.count_nonzero(ordered[1:] != ordered[:-1]) + bool(len(ordered))])
        _, first = np.unique(mix(hashes + (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        return np.bincount(of[first], minlength=rows)

    varied = distinct(words.hashes, row)
    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pairs = words.hashes[:-1] * np.uint64(3) + words.hashes[1:] if len(row) else words.hashes
    pair_row = row[:-1][inside] if len(row) else row
    n_pairs = np.bincount(pair_row, minlength=rows).astype(float)
    varied_pairs = distinct(pairs[inside], pair_row)
    stutter = np.bincount(pair_row[(words.hashes[:-1] == words.hashes[1:])[inside]], minlength=rows)
    letters = counts[:, _LETTER] + counts[:, _UPPER]
    angle = lambda share: np.arcsin(np.sqrt(np.clip(share, 0, 1)))
    # Shares of short texts are drawn towards a usual value, with the weight of so many characters or words.
    near = lambda part, whole, usual, weight: (part + usual * weight) / (whole + weight)
    of_chars = lambda k, usual: angle(near(counts[:, k], chars, usual, CHARS))
    return np.column_stack(
        [
            angle(near(counts[:, _UPPER], letters, 0.03, CHARS)),
            of_chars(_DIGIT, 0.002),
            of_chars(_STOP, 0.03),
            of_chars(_BANG, 0.0),
            of_chars(_MARK, 0.0),
            of_chars(_BLANK, 0.16),
            np.log(near(per_row(sizes), n_words, 5.0, WORDS)),
            angle(near(per_row((sizes <= 3).astype(float)), n_words, 0.35, WORDS)),
            angle(near(varied, n_words, 0.8, WORDS)),
            angle(near(stutter, n_words, 0.0, WORDS)),
            np.log(near(chars, n_lines, 300.0, 2.0)),
            angle(near(n_pairs - varied_pairs, n_pairs, 0.05, WORDS)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities and the share of label 1."""

    share: float
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        logs = []
        for k in (0, 1):
            z = solved(self.factors[k], x - self.means[k])
            logs.append(-0.5 * (z * z).sum(axis=1) - self.logdets[k])
        margin = logs[1] - logs[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def solved(low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows ``z`` with ``low @ z = d``, by forward substitution."""
    z = np.empty_like(d)
    for k in range(len(low)):
        z[:, k] = (d[:, k] - z[:, :k] @ low[k, :k]) / low[k, k]
    return z


def fit(x: np.ndarray, y: np.ndarray, share: float, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Class means, and Cholesky factors of the shrunk covariances."""
    if not 0 < share < 1 or min((y == 0).sum(), (y == 1).sum()) < 1:
        return Discriminant(share, np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0))
    spread = [np.cov(x[y == k].T, bias=True) if (y == k).sum() > 1 else np.zeros((x.shape[1],) * 2) for k in (0, 1)]
    common = sum(s * (y == k).mean() for k, s in enumerate(spread))
    means, factors, logdets = [], [], []
    for k in (0, 1):
        own = (1 - pooled) * spread[k] + pooled * common
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-4 * np.eye(len(own))
        low = np.linalg.cholesky(own)
        means.append(x[y == k].mean(axis=0))
        factors.append(low)
        logdets.append(np.log(np.diag(low)).sum())
    return Discriminant(share, np.array(means), np.array(factors), np.array(logdets))


def _remainder(of: str, n: int):
    return F.crc32(F.col(of).cast("string")) % n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Fit on labelled documents whose crc32 modulo 5 is not 0."""
    spark = docs.sparkSession
    importable(spark)
    labels = labels.where("quality in (0, 1) and doc_id is not null").where(_remainder("doc_id", 5) != 0)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), share)
    # A uniform number of each id; the bound lets 1.2 times the sample through, the sort below trims it.
    u = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30))
    bound = {k: int(min(1.0, 1.2 * sample / n) * (1 << 30)) for k, n in counts.items()}
    chosen = labels.withColumn("u", u).where(F.col("u") < F.when(F.col("quality") == 0, bound[0]).otherwise(bound[1]))
    picked = []
    for k in (0, 1):
        picked += chosen.where(F.col("quality") == k).orderBy("u", "doc_id").limit(sample).collect()
    ids = spark.createDataFrame([(k,) for k in {r["doc_id"] for r in picked}], "_kw_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("_kw_id"))
    # An id may have any number of rows; one text of each comes to the driver, as its statistics.
    rows = rows.groupBy("_kw_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    known = {r["doc_id"]: r["x"] for r in rows.mapInArrow(_measured, "doc_id long, x array<double>").collect()}
    picked = [r for r in picked if r["doc_id"] in known]
    x, y = np.array([known[r["doc_id"]] for r in picked]).reshape(len(picked), len(FEATURES)), np.array([r["quality"] for r in picked])
    order = np.lexsort([*x.T, y])  # the same sums, whatever order the rows came in
    return fit(x[order], y[order], share)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in slices(batch.column(1)):
            x = statistics(batch.column(1).slice(begin, end - begin))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], ["doc_id", "x"])


def score_documents(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                score = model.score(statistics(batch.column(1).slice(begin, end - begin)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows scored under ``cut``; columns and rows stay as they are."""
    model = train(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(at)):
                part = batch.slice(begin, end - begin)
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
