"""Cutting lineage with tables in the shared folder that the cluster names.

Every iterative operator writes its state as Parquet below ``spark.checkpoint.dir`` and
reads it back. Such a table outlives any executor and, unlike a local checkpoint, has no
single copy that can be lost.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests on
    one machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_root()
    return root.rstrip("/")


@lru_cache(1)
def _own_root() -> str:
    folder = tempfile.mkdtemp(prefix="pairwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


#: Spark's setting that deletes shuffle files at the end of an execution.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that this process made below the shared folder and has not deleted.
_LIVE: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _LIVE.append(path := f"{shared_root(spark)}/pairwright/{label}-{uuid.uuid4().hex}")
    return path


@contextmanager
def temporary(spark: SparkSession, keep: Scratch | None = None):
    """Deletes, at its end, whatever was stored in the shared folder within it, but for the tables of ``keep``.

    Results are lazy and read tables that stay behind them; who uses a result within this context leaves nothing::

        with temporary(spark):
            near_groups(docs).write.parquet(path)

    One process, one thread at a time.
    """
    before = set(_LIVE)
    try:
        yield
    finally:
        mine = set(keep.paths[i][1] for i in keep.paths) if keep else set()
        for path in [p for p in _LIVE if p not in before and p not in mine]:
            delete(spark, path)


@contextmanager
def _cleaning(spark: SparkSession):
    """Within it, a job's shuffle files go when it ends, not when the driver happens to collect its garbage: what
    a stored table needed is never asked for again."""
    old = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if old is None else spark.conf.set(CLEAN, old)


class Scratch:
    """The intermediate tables of one operator call.

    ``write`` stores a DataFrame and returns it as read back; ``drop`` deletes tables that
    nothing needs any more. Tables behind a returned, still lazy result must stay: they
    are as long-lived as the cluster's checkpoint folder, unless the caller works within :func:`temporary`.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = new_path(self.spark, f"{self.label}-{name}")
        with _cleaning(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def counted(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
        """``write``, and how many rows that were; of a table of a file or so the footers say it."""
        out = self.write(df, name)
        return out, out.count()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if df is not None and id(df) in self.paths:
                delete(self.spark, self.paths.pop(id(df))[1])


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if path in _LIVE:
        _LIVE.remove(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
