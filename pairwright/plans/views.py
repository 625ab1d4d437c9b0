"""Weighted graphs that lie in star-schema tables. All weights are whole numbers, so sums are exact in any order.

Tables that both grow with the data are joined by shuffle from the start (a hint): a broadcast of one would
also leave the work to the few tasks that scan the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.sum("w").cast("double").alias("w"))


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ordered together; the weight is the quantity of both. One shuffle by order: both sides of the self-join share it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    a, b = lines.alias("a"), lines.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.p") < F.col("b.p")))
    return _edges(met.select(F.col("a.p").alias("u"), F.col("b.p").alias("v"), (F.col("a.q") + F.col("b.q")).alias("w")))


def custsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and their suppliers (odd ids), weighted by quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (2 * F.col("l_suppkey") + 1).alias("s"), F.col("l_quantity").alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (2 * F.col("o_custkey")).alias("c"))
    met = lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)
    return _edges(met.select(F.least("c", "s").alias("u"), F.greatest("c", "s").alias("v"), "w"))


def nationtrade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from the customer's nation to the supplier's, self loops and both directions kept apart."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    met = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy("src", "dst").agg(F.sum("l_quantity").cast("double").alias("w"))


def nationtrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between different nations, both directions together."""
    arcs = nationtrade_arcs(spark, sf_dir).filter("src <> dst")
    return _edges(arcs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "w"))
