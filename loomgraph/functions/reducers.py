"""Folds over groups: the commutative reducers, ordered collections, and custom monoids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name -> aggregate; every one is folded map-side.
REDUCERS: dict[str, Callable[..., Column]] = {
    "add": F.sum, "mul": F.product, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor, "max": F.max, "min": F.min, "count": F.count,
}


def reduce_by(df: DataFrame, keys: list[str], **folds: tuple[str, str]) -> DataFrame:
    """One row per key; ``folds`` maps an output name to (reducer, column)."""
    return df.groupBy(*keys).agg(*(REDUCERS[r](F.col(c)).alias(name) for name, (r, c) in folds.items()))


def index_of(df: DataFrame, keys: list[str], index: str, value: str, greatest: bool = True) -> DataFrame:
    """Per key the index of the greatest (least) value, the least index on ties, and the value."""
    if greatest:
        best, found = F.max_by(index, F.struct(F.col(value), -F.col(index))), F.max(value)
    else:
        best, found = F.min_by(index, F.struct(F.col(value), F.col(index))), F.min(value)
    return df.groupBy(*keys).agg(best.alias(index), found.alias(value))


def _in_order(order: str, value: str, ascending: bool = True) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))), asc=ascending)


def append(df: DataFrame, keys: list[str], order: str, value: str, prepend: bool = False) -> DataFrame:
    """Per key the values in order (or in reverse) as an array."""
    return df.groupBy(*keys).agg(F.transform(_in_order(order, value, not prepend), lambda r: r["v"]).alias("values"))


def joined_text(df: DataFrame, keys: list[str], order: str, value: str, separator: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(F.concat_ws(separator, F.transform(_in_order(order, value), lambda r: r["v"].cast("string"))).alias("text"))


def stable_sum(df: DataFrame, keys: list[str], value: str, scale: int = 18) -> DataFrame:
    """Sums that don't depend on the order of rows: doubles are rounded to a decimal and added exactly."""
    return df.groupBy(*keys).agg(F.sum(F.col(value).cast(f"decimal(38,{scale})")).cast("double").alias(value))


def custom(df: DataFrame, keys: list[str], fold: Callable[[pd.Series], float], value: str, kind: str = "double") -> DataFrame:
    """A fold that no built-in expresses, over each group's values; groups must fit a task."""
    return df.groupBy(*keys).agg(F.pandas_udf(fold, kind)(F.col(value)).alias(value))


def performance_summary(points: DataFrame) -> DataFrame:
    """benchmark, workers, n, least, most, mean and speed-up over one worker of (benchmark, workers, seconds)."""
    per = points.groupBy("benchmark", "workers").agg(F.count("*").alias("n"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.avg("seconds").alias("mean"))
    one = per.where("workers = 1").select("benchmark", F.col("mean").alias("_one"))
    return per.join(one, "benchmark", "left").withColumn("speed_up", F.col("_one") / F.col("mean")).drop("_one")
