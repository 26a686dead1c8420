"""Registered round trips: a derived graph is written to the shared folder in a format and reread; SQL is the table itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import convert
from ..operators import partition, prep
from ..sources import files
from . import registry
from .state import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str):
    def held(query):
        QUERIES[name], SQL[name] = query, sql
        return query

    return held


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and the vertices 0 to the greatest id."""
    edges = registry.sparse(spark, d).edges.select("src", "dst", "weight")
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return edges, spark.range((-1 if top is None else top) + 1).select("id")


def _adjacency(spark: SparkSession, d: str, weighted: bool) -> DataFrame:
    path = _place(spark, "adjacency")
    files.write_adjacency(*_graph(spark, d), path, weighted)
    return files.read_graph(spark, path)[0]


@register("file_adjacency", f"WITH {registry.SPARSE}, {registry.NUMBERED} SELECT src, dst, CAST(1 AS BIGINT) AS weight, pos FROM p")
def file_adjacency(spark, d):
    return _adjacency(spark, d, False)


@register("file_adjacency_weighted", f"WITH {registry.SPARSE}, {registry.NUMBERED} SELECT src, dst, weight, pos FROM p")
def file_adjacency_weighted(spark, d):
    return _adjacency(spark, d, True)


@register("file_edge_array", f"WITH {registry.SPARSE}, {registry.NUMBERED} SELECT src, dst, weight, pos FROM p")
def file_edge_array(spark, d):
    path = _place(spark, "edges")
    files.write_edge_array(_graph(spark, d)[0], path, weighted=True)
    return files.read_edge_array(spark, path)


@register("file_snap", f"WITH {registry.SPARSE} SELECT src, dst FROM e")
def file_snap(spark, d):
    path = _place(spark, "snap")
    files.write_snap(_graph(spark, d)[0], path)
    return files.read_snap(spark, path)[0]


@register("file_matrix_market", f"WITH {registry.SPARSE} SELECT src AS row, dst AS col, CAST(weight AS DOUBLE) AS val FROM e WHERE weight <> 0")
def file_matrix_market(spark, d):
    edges, vertices = _graph(spark, d)
    path, n = _place(spark, "matrix"), vertices.count()
    files.write_matrix_market(prep.matrix_entries(edges), n, n, path)
    return files.read_matrix_market(spark, path)[0]


@register("file_integers", f"WITH {registry.SPARSE}, {registry.NUMBERED} SELECT pos AS at, weight AS value FROM p")
def file_integers(spark, d):
    path = _place(spark, "integers")
    placed = registry.placed(spark, d)
    files.write_integers(placed.select(F.col("pos").alias("at"), F.col("weight").alias("value")), path)
    return files.read_integers(spark, path)


@register("matrix_to_edges", f"WITH {registry.SPARSE} SELECT src, dst FROM e")
def matrix_to_edges(spark, d):
    return prep.edges_from_matrix(prep.matrix_entries(_graph(spark, d)[0]))


@register("convert_transpose", f"WITH {registry.SPARSE} SELECT dst AS src, src AS dst, weight, row_number() OVER (ORDER BY dst, src) - 1 AS pos FROM e")
def convert_transpose(spark, d):
    source, target = _place(spark, "adjacency"), _place(spark, "adjacency")
    files.write_adjacency(*_graph(spark, d), source, True)
    convert.transpose_adjacency(spark, source, target, weighted=True)
    return files.read_adjacency(spark, target)[0]


@register("convert_snap_symmetric", f"WITH {registry.SPARSE}, y AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src, dst, CAST(1 AS BIGINT) AS weight, row_number() OVER (ORDER BY src, dst) - 1 AS pos FROM y")
def convert_snap_symmetric(spark, d):
    source, target = _place(spark, "snap"), _place(spark, "adjacency")
    files.write_snap(_graph(spark, d)[0], source)
    convert.snap_to_adjacency(spark, source, target, symmetric=True)
    return files.read_adjacency(spark, target)[0]


@register("convert_edge_array", f"WITH {registry.SPARSE}, {registry.NUMBERED} SELECT src, dst, weight, pos FROM p")
def convert_edge_array(spark, d):
    source, target = _place(spark, "adjacency"), _place(spark, "edges")
    files.write_adjacency(*_graph(spark, d), source, True)
    convert.adjacency_to_edge_array(spark, source, target, weighted=True)
    return files.read_edge_array(spark, target)


@register("map_parts", f"WITH {registry.SPARSE}, {registry._IN}, {registry._RANGES} SELECT part, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, max(src) AS last FROM e JOIN u ON id = dst GROUP BY part")
def map_parts(spark, d):
    g = registry.sparse(spark, d)
    ranges = partition.edge_balanced(registry.in_degrees(g), registry.PARTS)
    return partition.map_parts(g.edges, ranges, F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.max("src").alias("last"))


@register("vebo_graph", f"WITH RECURSIVE {registry.SPARSE}, {registry._IN}, {registry.VEBO} SELECT a.new_id AS src, b.new_id AS dst, weight FROM e JOIN z a ON a.old_id = src JOIN z b ON b.old_id = dst")
def vebo_graph(spark, d):
    g = registry.sparse(spark, d)
    return partition.vebo_graph(g.edges.select("src", "dst", "weight"), registry.in_degrees(g), registry.PARTS)
