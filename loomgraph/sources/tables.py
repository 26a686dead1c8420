"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import prefix_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> DataFrame:
    """src, dst, weight: parts of consecutive returned lines of an order; weight is the sum of the first's quantity."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    if least_quantity is not None:
        lines = lines.where(F.col("l_quantity") > least_quantity)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    chained = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").cast("long").alias("q"))
    return chained.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.sum("q").alias("weight"))


def part_chain_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_chain(spark, sf_dir, 25)


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: suppliers and their parts in one id space (a part's id is -1 - l_partkey)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")).distinct()


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: lines from a supplier's nation to a customer's. Lines are counted by (supplier, customer's
    nation) before the second join."""
    read = lambda name: table(spark, sf_dir, name)
    orders = read("orders").select("o_orderkey", "o_custkey").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sold = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(orders, "o_orderkey").groupBy("l_suppkey", "c_nationkey").agg(F.count("*").alias("n"))
    named = sold.join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return named.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum("n").alias("weight"))


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: users of consecutive events."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    before = prefix_scan(events, ["ts", "event_id"], F.col("user_id"), "src", fold="last", inclusive=False)
    return before.where("src is not null and src <> user_id").groupBy("src", F.col("user_id").alias("dst")).agg(F.count("*").alias("weight"))


def widest(edges: DataFrame) -> int:
    """The vertex with the most out-edges, the least id on ties."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("d"))
    return degrees.agg(F.max_by("src", F.struct("d", -F.col("src")))).first()[0]
