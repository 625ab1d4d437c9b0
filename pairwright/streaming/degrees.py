"""Vertex statistics of a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.graph import arcs_of
from pairwright.plans.schema import EDGES
from pairwright.plans.storage import new_path


def running_degrees(edges: DataFrame) -> DataFrame:
    """``id, degree, weighted_degree`` of all edges ``(u, v, w)`` that have arrived; for output mode complete or update."""
    return arcs_of(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))


def degrees_of_files(spark: SparkSession, path: str, files_at_once: int = 2) -> DataFrame:
    """``id, degree, weighted_degree`` after a stream has taken all edges in the Parquet files of a folder, some files a batch.

    Every batch appends the vertices that it changed, with its number; the last word on a vertex counts. So no
    batch writes more than it changed, and one that is run again replaces its own files.
    """
    out = new_path(spark, "stream")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", files_at_once).parquet(path)
    query = running_degrees(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.max(F.struct("batch", "degree", "weighted_degree")).alias("x")
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("id").agg(last).select("id", "x.degree", "x.weighted_degree")
