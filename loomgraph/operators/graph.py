"""The graph: an edge table and a vertex table, with the layouts that iterations read."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import cut_dealt, shuffle_partitions

#: A source is a hub when it has more edges than this and more than a quarter of an average partition.
HUB_EDGES = 100_000


class Graph:
    """``edges`` (src, dst, weight, pos: all long) and ``vertices`` (id long).

    Multi-edges and self-loops are kept and count each. ``symmetric`` promises that every edge's reverse is there.
    Sources with more than ``hub_edges`` edges, and a quarter of an average partition, have theirs dealt over all partitions.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False, hub_edges: int = HUB_EDGES):
        names = edges.columns
        weight = F.col("weight") if "weight" in names else F.lit(1)
        pos = F.col("pos") if "pos" in names else F.lit(None)
        self.edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), weight.cast("long").alias("weight"), pos.cast("long").alias("pos"), *(c for c in names if c not in {"src", "dst", "weight", "pos"}))
        if vertices is None:
            vertices = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        self.vertices = vertices.select(F.col("id").cast("long"))
        self.symmetric = symmetric
        self.hub_edges = hub_edges

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @functools.cached_property
    def parts(self) -> int:
        return shuffle_partitions(self.spark)

    @functools.cached_property
    def out_degrees(self) -> DataFrame:
        """id and out_degree of every source, dealt and sorted by id; counted map-side, whatever a source's edges."""
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        return cut_dealt(counted.repartition(self.parts, "id").sortWithinPartitions("id"))

    @functools.cached_property
    def m(self) -> int:
        return self.out_degrees.agg(F.coalesce(F.sum("out_degree"), F.lit(0))).first()[0]

    @functools.cached_property
    def hubs(self) -> DataFrame | None:
        """src of the hubs, or None without any. Fewer than four a partition can have that many edges: fit to broadcast."""
        found = cut_dealt(self.out_degrees.where(F.col("out_degree") > max(self.hub_edges, self.m // (4 * self.parts))).select(F.col("id").alias("src")))
        return None if found.isEmpty() else found

    @functools.cached_property
    def light(self) -> DataFrame:
        """Edges of all but the hubs, dealt and sorted by source, once; every round's join with state dealt by id reads
        them in place."""
        own = self.edges if self.hubs is None else self.edges.join(F.broadcast(self.hubs), "src", "left_anti")
        return cut_dealt(own.repartition(self.parts, "src").sortWithinPartitions("src"))

    @functools.cached_property
    def heavy(self) -> DataFrame | None:
        """The hubs' edges, dealt evenly by both ends."""
        if self.hubs is None:
            return None
        return cut_dealt(self.edges.join(F.broadcast(self.hubs), "src").repartition(self.parts, "src", "dst", "pos"))

    def along(self, sources: DataFrame) -> DataFrame:
        """Edges with the columns of ``sources`` (src, ...; one row a source): in place, and the hubs' by a broadcast of
        the hubs' own rows."""
        met = self.light.join(sources, "src")
        if self.heavy is None:
            return met
        return met.unionByName(self.heavy.join(F.broadcast(sources.join(F.broadcast(self.hubs), "src")), "src"))

    @functools.cached_property
    def ids(self) -> DataFrame:
        """id and out_degree of every vertex, dealt and sorted by id."""
        every = self.vertices.repartition(self.parts, "id").join(self.out_degrees, "id", "left")
        return cut_dealt(every.select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree")).repartition(self.parts, "id").sortWithinPartitions("id"))

    @functools.cached_property
    def n(self) -> int:
        return self.ids.count()

    def transpose(self) -> Graph:
        """Every edge turned round; a symmetric graph is its own transpose."""
        if self.symmetric:
            return self
        rest = [c for c in self.edges.columns if c not in {"src", "dst"}]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.vertices, hub_edges=self.hub_edges)

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree of every vertex."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
        with_all = ends.unionByName(self.vertices.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
        return with_all.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))

    def neighbours(self) -> DataFrame:
        """src, place, dst, weight: the edges of a source numbered from 0 by (dst, pos)."""
        from pyspark.sql import Window

        w = Window.partitionBy("src").orderBy("dst", "pos", "weight")
        return self.edges.select("src", (F.row_number().over(w) - 1).alias("place"), "dst", "weight")

    def check_source(self, source: int) -> None:
        if self.vertices.where(F.col("id") == source).isEmpty():
            raise ValueError(f"vertex {source} isn't in the graph")
