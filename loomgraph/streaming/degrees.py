"""Degrees of a growing edge stream, kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree over a streaming (or static) edge table."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def start(edges: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return running_degrees(edges).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
