"""Connected components of a link table by alternating star contractions.

Each half-round hangs a vertex's neighbours below its least neighbour (large star: the greater ones, small star: the
lesser ones) until every component is one star; rounds grow with the logarithm of the links, not with the diameter. A
half-round is one grouped minimum (folded map-side, so hubs are no problem) and one join whose skewed keys the engine
can split. No link or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import materialize, release


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every vertex hangs below one other at most, and none that others hang below hangs itself."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return chained.isEmpty() and several.isEmpty()


def star_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b long) that is linked to another; component is the least id
    reachable."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialize(edges, "stars")
    for _ in range(max_rounds):
        if _is_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least_neighbour(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        made = materialize(small, "stars")
        release(edges)
        edges = made
    else:
        raise RuntimeError(f"the components aren't stars after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
