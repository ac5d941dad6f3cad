"""Written tables that cut lineage between the rounds of an iteration.

They live in the folder of ``spark.checkpoint.dir``, which all executors share,
so a round survives the loss of any of them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one is set where that is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
    return shared_dir(spark)


_roots: list[str] = []
#: Shuffle files go as soon as the table is written, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sweep(spark: SparkSession) -> None:
    """Delete the scratch folders of this driver, once no result is read any more."""
    while _roots:
        _delete(spark, _roots.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A folder of intermediate tables.

    An operator drops the tables that its result does not read; those that it
    does stay until :func:`sweep`. ``lean`` folders spare disk: their tables are
    packed closer, and the shuffle files of a table go when it is written.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False):
        self.spark = spark
        self.lean = lean
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.append(self.root)
        self._made = 0
        self._held: set[str] = set()

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write a table once and read it from there."""
        self._made += 1
        at = f"{self.root}/{self._made:03d}-{name}"
        if self.lean:
            self._write_lean(df, at)
        else:
            df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kinweave_at = at
        self._held.add(at)
        return out

    def _write_lean(self, df: DataFrame, at: str) -> None:
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of one schema, all kept here, as one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*(vars(df)["_kinweave_at"] for df in tables))

    def merged(self, tables: list[DataFrame]) -> DataFrame:
        """The same as one table: the files of the others move to the folder of the first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        into = vars(tables[0])["_kinweave_at"]
        fs = hadoop.Path(into).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for df in tables[1:]:
            for status in fs.globStatus(hadoop.Path(f"{vars(df)['_kinweave_at']}/part-*")):
                if not fs.rename(status.getPath(), hadoop.Path(into, status.getPath().getName())):
                    raise OSError(f"{status.getPath()} was not moved to {into}")
        self.drop(*tables[1:])
        out = self.spark.read.schema(tables[0].schema).parquet(into)
        out._kinweave_at = into
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this folder that nothing reads any more."""
        for df in tables:
            at = vars(df).get("_kinweave_at") if df is not None else None
            if at in self._held:
                self._held.remove(at)
                _delete(self.spark, at)

    def only(self, *tables: DataFrame | None) -> None:
        """Delete all tables of this folder but these."""
        stay = {vars(df).get("_kinweave_at") for df in tables if df is not None}
        for at in sorted(self._held - stay):
            self._held.remove(at)
            _delete(self.spark, at)
