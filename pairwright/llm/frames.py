"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *own: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names compare as Spark's do, without case."""
    low = {c.lower() for c in own}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def row_key(id_col: str, text_col: str):
    """64 bits of a row's id and text, to tell rows that repeat an id apart."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def sheltering_also(*own: str) -> Callable:
    """Like :func:`sheltering`, for operators that return a table's own columns alone: those that are called as what the
    work adds meanwhile go by other names, too."""
    return partial(_sheltering, frozenset(own))


def sheltering(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their helper columns with two leading underscores; a table's own columns of such names
    go by other names meanwhile."""
    return _sheltering(frozenset(), operator)


def _sheltering(own: frozenset, operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = {c: f"sheltered_{i}_{c.strip('_')}" for i, c in enumerate(docs.columns) if c.startswith("__") or c.lower() in own}
        if not names:
            return operator(docs, *args, **kwargs)
        return operator(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run
