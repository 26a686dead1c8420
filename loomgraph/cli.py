"""Run one algorithm over a graph file: ``python -m loomgraph.cli pagerank graph.txt --out ranks``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import unit
from .operators import partition, prep, rank, traversal
from .operators.graph import Graph
from .sources.files import read_graph

ALGORITHMS = {
    "bfs": lambda g, a: traversal.bfs(g, a.source),
    "bc": lambda g, a: traversal.betweenness(g, a.source),
    "components": lambda g, a: traversal.components(g, directed=not a.symmetric),
    "bellman_ford": lambda g, a: traversal.shortest_paths(g, a.source),
    "pagerank": lambda g, a: rank.pagerank(g),
    "pagerank_shrinking": lambda g, a: rank.pagerank_shrinking(g),
    "pagerank_converge": lambda g, a: rank.pagerank_converge(g),
    "pagerank_delta": lambda g, a: rank.pagerank_delta(g),
    "bp": lambda g, a: beliefs(g),
    "spmv": lambda g, a: rank.spmv(g),
    "degrees": lambda g, a: g.degrees(),
    "vebo": lambda g, a: partition.vebo(_degrees(g, a), a.partitions),
    "ranges": lambda g, a: ranges(g, a),
}


def beliefs(g: Graph) -> DataFrame:
    """Beliefs after ten rounds, from potentials that hashes of the ends (of an edge) and of the id (of a vertex) give."""
    between = lambda k: unit(F.col("src") * 31 + F.col("dst") * 7 + k) * 0.8 + 0.1
    held = Graph(g.edges.select("src", "dst", *(between(k).alias(f"e{k // 2}{k % 2}") for k in range(4))), g.vertices)
    own = unit(F.col("id"))
    return rank.belief_propagation(held, g.vertices.select("id", own.alias("v0"), (1 - own).alias("v1")))


def _degrees(g: Graph, a: argparse.Namespace) -> DataFrame:
    side = "in_degree" if a.partition_by == "dest" else "out_degree"
    return g.degrees().select("id", F.col(side).alias("degree"))


def ranges(g: Graph, a: argparse.Namespace) -> DataFrame:
    """id, part by the chosen balance; a relabelled graph starts a new part wherever the in-degree rises."""
    if a.relabelled:
        return partition.rising_ranges(g.degrees().select("id", F.col("in_degree").alias("degree")), a.partitions)
    if a.balance == "vertex":
        return partition.vertex_balanced(g.vertices, g.n, a.partitions)
    return partition.edge_balanced(_degrees(g, a), a.partitions)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("algorithm", choices=sorted(ALGORITHMS))
    p.add_argument("path")
    p.add_argument("-s", "--symmetric", action="store_true", help="the file holds every edge's reverse")
    p.add_argument("--symmetrise", action="store_true", help="add reverses, drop loops and duplicates first")
    p.add_argument("-b", "--binary", action="store_true", help="binary input")
    p.add_argument("--format", default=None)
    p.add_argument("-r", "--source", type=int, default=0)
    p.add_argument("--rounds", type=int, default=1, help="timed repetitions")
    p.add_argument("-c", "--partitions", type=int, default=384)
    p.add_argument("-P", "--partition-by", choices=("dest", "source"), default="dest")
    p.add_argument("-v", "--balance", choices=("edge", "vertex"), default="edge")
    p.add_argument("-o", "--relabelled", action="store_true")
    p.add_argument("--out", help="Parquet folder for the result; without it only the first rows are shown")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    edges, vertices = read_graph(spark, a.path, a.format or ("binary" if a.binary else "adjacency"))
    for number in range(a.rounds):
        graph = Graph(prep.symmetrise(edges) if a.symmetrise else edges, vertices, symmetric=a.symmetric or a.symmetrise)
        began = time.perf_counter()
        result = ALGORITHMS[a.algorithm](graph, a)
        result.write.mode("overwrite").parquet(a.out) if a.out else result.show()
        print(f"round {number + 1}: {time.perf_counter() - began:.2f} s")


if __name__ == "__main__":
    main()
