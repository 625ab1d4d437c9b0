"""Community assignments as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dump_communities(comm: DataFrame, path: str, order: DataFrame | None = None) -> None:
    """One community id a line, by vertex id; ``order (id, idx)`` gives vertices their old numbers back. Files, by name, are in order."""
    if order is not None:
        comm = comm.join(order, "id").select(order.idx.alias("id"), "c")
    comm.orderBy("id").selectExpr("cast(c as string) as value").write.mode("overwrite").text(path)
