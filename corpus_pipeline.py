"""The corpus pipeline: five stages over the table ``documents``.

Each stage takes what its predecessor kept, written and read again, and its
decisions take effect: documents of low quality go, repeated lines go, one
document of each near-duplicate class stays (the smallest id), documents that
overlap with a benchmark item go, and the rest is packed. All but the last
return the columns of ``documents``.

Stages meet nulls as their operators do: a null text is an empty one, and rows
with a null id are neither joined nor dropped by their links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontaminate as _decontaminate
from kinweave.llm import line_dedup as _line_dedup
from kinweave.llm import ngram_join as _ngram_join
from kinweave.llm import packing as _packing
from kinweave.llm import quality as _quality
from kinweave.llm.shared import Scratch, importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the discriminant and the packing; tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return _quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document has; ``n_chars`` is that of the new text."""
    return _line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram join."""
    return _ngram_join.keep_one_of_each(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return _packing.pack_documents(docs, special_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontaminate", benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is a written table."""
    importable(spark)
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`run` returns, with the ids as a digest."""
    return _packing.with_digest(run(spark, sf_dir))
