"""Networks that the relational tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.graph import scaled, symmetrised
from braidwork.session import cut, table


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue between nations of suppliers and customers, both directions added, as shares of the largest.

    Orders and lines are joined on their key and summed by pair of nations before anything else is done. The
    result, at most a row per pair of nations, is written once, as measures read it several times; nothing is
    kept from call to call, so tables that change are always read anew.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    summed = joined.groupBy("src", "dst").agg(F.sum("revenue").alias("w"))
    return cut(scaled(symmetrised(summed.select(F.lit(0).alias("net"), "src", "dst", "w"))))


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities between suppliers and parts, a row for each line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"), F.col("l_quantity").alias("w"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities between suppliers and parts, in both directions; a supplier's node is minus its key less one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    one = lines.select(F.lit(0).alias("net"), (-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), "w")
    return one.union(one.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their regions as communities."""
    return table(spark, sf_dir, "nation").select(F.lit(0).alias("net"), F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
