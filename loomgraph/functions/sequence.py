"""Sequence primitives over an ordered table: scans, packs, reductions, order checks.

A global scan runs in two passes: rows are dealt in ranges of the order, each range is scanned on its own, and the
ranges' totals (one row per partition) are scanned apart and added. No task sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import cut, shuffle_partitions

_FOLDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "min": (F.min, lambda a, b: F.least(a, b), None),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
    "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b), 0),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "last": (F.last, lambda a, b: b, None),
}


def prefix_scan(df: DataFrame, order: list[str], value: Column, into: str = "scan", fold: str = "sum", inclusive: bool = True, backward: bool = False) -> DataFrame:
    """``df`` with the running ``fold`` of ``value`` in ``order`` (columns that make the order total).

    Exclusive scans start from the fold's identity (0, or null for min, max and last). ``last`` exclusive is the value
    of the row before.
    """
    one, both, identity = _FOLDS[fold]
    keys = [F.desc(c) if backward else F.asc(c) for c in order]
    tagged = cut(df.withColumn("_v", value).repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("_p", F.spark_partition_id()))
    if fold == "last":
        least = F.min_by if backward else F.max_by
        totals = tagged.groupBy("_p").agg(least("_v", F.struct(*order)).alias("_t"))
    else:
        totals = tagged.groupBy("_p").agg(one("_v").alias("_t"))
    ranges = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = totals.select("_p", one("_t").over(ranges).alias("_b"))
    own = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = tagged.join(F.broadcast(before), "_p").withColumn("_o", one("_v").over(own))
    total = F.when(F.col("_b").isNull(), F.col("_o")).when(F.col("_o").isNull(), F.col("_b")).otherwise(both(F.col("_b"), F.col("_o")))
    return joined.withColumn(into, F.coalesce(total, F.lit(identity)) if identity is not None else total).drop("_v", "_p", "_b", "_o")


def with_position(df: DataFrame, order: list[str], into: str = "pos") -> DataFrame:
    """Rows numbered from 0 in ``order``."""
    return prefix_scan(df, order, F.lit(1).cast("long"), into, inclusive=False)


def enumerate_flags(df: DataFrame, order: list[str], flag: Column, into: str = "number") -> DataFrame:
    """For each row the number of flagged rows before it."""
    return prefix_scan(df, order, F.when(flag, 1).otherwise(0).cast("long"), into, inclusive=False)


def pack(df: DataFrame, flag: Column) -> DataFrame:
    return df.where(flag)


def pack_index(df: DataFrame, order: list[str], flag: Column, into: str = "number") -> DataFrame:
    """Flagged rows with their number among the flagged."""
    return enumerate_flags(df, order, flag, into).where(flag)


def pack_two(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which ``flag`` holds, and all others (an unknown flag doesn't hold)."""
    holds = F.coalesce(flag, F.lit(False))
    return df.where(holds), df.where(~holds)


def reduce_column(df: DataFrame, value: Column, fold: str = "sum", into: str = "value") -> DataFrame:
    return df.agg(_FOLDS[fold][0](value).alias(into))


def reduce_pair(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def argmax(df: DataFrame, index: str, value: Column) -> DataFrame:
    """One row: the least index of the greatest value, and that value."""
    return df.agg(F.max_by(index, F.struct(value, -F.col(index))).alias("index"), F.max(value).alias("value"))


def l1_distance(df: DataFrame, a: Column, b: Column, into: str = "l1") -> DataFrame:
    return df.agg(F.sum(F.abs(a - b)).alias(into))


def bucket_offsets(df: DataFrame, key: str) -> DataFrame:
    """key, n, start: size and first place of every value's bucket in sorted order."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return prefix_scan(sizes, [key], F.col("n"), "start", inclusive=False)


def is_sorted(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """One row: whether ``value`` never falls in ``order``."""
    before = prefix_scan(df, order, F.col(value), "_before", fold="last", inclusive=False)
    return before.agg(F.coalesce(F.bool_and(F.coalesce(F.col("_before") <= F.col(value), F.lit(True))), F.lit(True)).alias("sorted"))


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def median(df: DataFrame, value: Column, into: str = "median") -> DataFrame:
    return df.agg(F.percentile(value, 0.5).alias(into))


def log2_up(x: Column) -> Column:
    """The least k with 2^k >= x, 0 for x <= 1."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin((x - 1).cast("long")))).cast("int")


def round_up_pow2(x: Column) -> Column:
    return F.expr("1L").cast("long") * F.pow(F.lit(2), log2_up(x)).cast("long")


# keyed tables
def find(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_semi")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def insert(table: DataFrame, rows: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """A keyed table with more rows; of one key's rows the greatest value stays."""
    every = table.unionByName(rows)
    return every.select(key).distinct() if value is None else every.groupBy(key).agg(F.max(value).alias(value))
