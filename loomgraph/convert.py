"""Convert graph files: ``python -m loomgraph.convert snap_to_adjacency edges.txt graph.txt``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import add_weights
from .operators import partition, prep
from .operators.graph import Graph
from .sources import files


def snap_to_adjacency(spark: SparkSession, source: str, target: str, symmetric: bool = False) -> None:
    """``symmetric``: reverses are added and loops left out. Duplicates always go."""
    edges, n = files.read_snap(spark, source)
    files.write_adjacency(prep.symmetrise(edges) if symmetric else prep.remove_duplicates(edges), spark.range(n).select("id"), target)


def galois_to_adjacency(spark: SparkSession, source: str, target: str, weighted: bool = False) -> None:
    files.write_adjacency(*files.read_galois(spark, source), target, weighted)


def adjacency_to_galois(spark: SparkSession, source: str, target: str, weighted: bool = False) -> None:
    files.write_galois(*files.read_adjacency(spark, source), target, weighted)


def adjacency_to_edge_array(spark: SparkSession, source: str, target: str, weighted: bool = False) -> None:
    files.write_edge_array(files.read_adjacency(spark, source)[0], target, weighted)


def transpose_adjacency(spark: SparkSession, source: str, target: str, weighted: bool = False) -> None:
    edges, vertices = files.read_adjacency(spark, source)
    files.write_adjacency(prep.transpose(edges.drop("pos")), vertices, target, weighted)


def weigh_adjacency(spark: SparkSession, source: str, target: str) -> None:
    """Adjacency text with a deterministic weight for every edge, by its position."""
    edges, vertices = files.read_adjacency(spark, source)
    files.write_adjacency(add_weights(edges), vertices, target, weighted=True)


def reorder_adjacency(spark: SparkSession, source: str, target: str, parts: int = 384, by: str = "dest") -> DataFrame:
    """Adjacency text under the ids that balance ``parts`` by in-degree (``by="source"``: out-degree); returns the ids."""
    edges, vertices = files.read_adjacency(spark, source)
    degrees = Graph(edges.drop("pos"), vertices).degrees().select("id", F.col("in_degree" if by == "dest" else "out_degree").alias("degree"))
    mapping = partition.vebo(degrees, parts)
    files.write_adjacency(prep.relabel(edges.drop("pos"), mapping.select("old_id", "new_id")), vertices, target)
    return mapping


CONVERSIONS = {f.__name__: f for f in (snap_to_adjacency, galois_to_adjacency, adjacency_to_galois, adjacency_to_edge_array, transpose_adjacency, weigh_adjacency, reorder_adjacency)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("conversion", choices=sorted(CONVERSIONS))
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("-s", "--symmetric", action="store_true", help="snap_to_adjacency: add reverses")
    p.add_argument("-w", "--weighted", action="store_true", help="keep weights")
    p.add_argument("-c", "--parts", type=int, default=384, help="reorder_adjacency: parts to balance")
    a = p.parse_args(argv)
    given = {"snap_to_adjacency": {"symmetric": a.symmetric}, "weigh_adjacency": {}, "reorder_adjacency": {"parts": a.parts}}
    CONVERSIONS[a.conversion](SparkSession.builder.getOrCreate(), a.source, a.target, **given.get(a.conversion, {"weighted": a.weighted}))


if __name__ == "__main__":
    main()
