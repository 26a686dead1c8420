"""Edge-table preparation: loops, duplicates, symmetry, checks, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..functions.sequence import prefix_scan


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def remove_duplicates(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst)."""
    return edges.select("src", "dst").distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """(src, dst): every edge and its reverse once, without loops."""
    kept = edges.where("src <> dst").select("src", "dst")
    return kept.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in {"src", "dst"}))


def check(edges: DataFrame, n: int) -> DataFrame:
    """One row: whether all ends are in [0, n), edges, and the sum of out-degrees."""
    inside = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    by_source = edges.groupBy("src").agg(F.count("*").alias("degree"), F.bool_and(inside).alias("inside"))
    return by_source.agg(F.coalesce(F.bool_and("inside"), F.lit(True)).alias("inside"), F.coalesce(F.sum("degree"), F.lit(0)).alias("m"), F.count("*").alias("n_sources"))


def to_rows(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Compressed rows: id, start (exclusive running degree), degree, targets in (dst, weight) order."""
    rows = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("targets"))
    every = vertices.join(rows, "id", "left").select("id", F.coalesce("targets", F.array().cast("array<struct<dst:bigint,weight:bigint>>")).alias("targets")).withColumn("degree", F.size("targets").cast("long"))
    return prefix_scan(every, ["id"], F.col("degree"), "start", inclusive=False).select("id", "start", "degree", "targets")


def from_rows(rows: DataFrame) -> DataFrame:
    """Edges (src, place, dst, weight, pos) of compressed rows."""
    return rows.select(F.col("id").alias("src"), "start", F.posexplode("targets").alias("place", "t")).select("src", "place", F.col("t.dst").alias("dst"), F.col("t.weight").alias("weight"), (F.col("start") + F.col("place")).alias("pos"))


def matrix_entries(edges: DataFrame) -> DataFrame:
    """(row, col, val) of the weight matrix, entries of zero left out."""
    return edges.where("weight <> 0").select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").cast("double").alias("val"))


def edges_from_matrix(entries: DataFrame) -> DataFrame:
    """(src, dst) of a matrix's entries (row, col, ...), whatever their values."""
    return entries.select(F.col("row").alias("src"), F.col("col").alias("dst"))


def numbered(edges: DataFrame) -> DataFrame:
    """``edges`` with pos in (src, dst, weight) order."""
    return prefix_scan(edges, ["src", "dst", "weight"], F.lit(1).cast("long"), "pos", inclusive=False)


def csr_order(edges: DataFrame, by_destination: bool = False) -> DataFrame:
    keys = ["dst", "src"] if by_destination else ["src", "dst"]
    return edges.repartitionByRange(*keys).sortWithinPartitions(*keys)


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges under new ids; ``mapping`` is (old_id, new_id)."""
    to = lambda end: mapping.select(F.col("old_id").alias(end), F.col("new_id").alias(f"_{end}"))
    rest = [c for c in edges.columns if c not in {"src", "dst"}]
    return edges.join(to("src"), "src").join(to("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def random_mapping(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """(old_id, new_id): a permutation onto 0..n-1 that depends on the seed and the ids alone (32-bit hashes, then ids)."""
    shuffled = vertices.select("id", hash32(F.col("id").bitwiseXOR(hash32(F.lit(seed)))).alias("_h"))
    return prefix_scan(shuffled, ["_h", "id"], F.lit(1).cast("long"), "new_id", inclusive=False).select(F.col("id").alias("old_id"), "new_id")


def dense_ids(vertices: DataFrame) -> DataFrame:
    """(old_id, new_id): ids numbered from 0 in their order."""
    return prefix_scan(vertices.select("id"), ["id"], F.lit(1).cast("long"), "new_id", inclusive=False).select(F.col("id").alias("old_id"), "new_id")


def in_places(edges: DataFrame) -> DataFrame:
    """src, dst, weight, place: the edges into a vertex numbered from 0 by (src, weight)."""
    w = Window.partitionBy("dst").orderBy("src", "weight")
    return edges.select("src", "dst", "weight", (F.row_number().over(w) - 1).alias("place"))
