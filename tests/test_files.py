"""Round trips of every file format."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import convert
from loomgraph.sources import files

from .test_graph import EDGES, WEIGHTS

SIX = "AdjacencyGraph\n6\n15\n0\n2\n4\n7\n10\n14\n1\n2\n2\n4\n1\n4\n5\n0\n2\n4\n0\n1\n2\n5\n1\n"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_read_adjacency(spark, tmp_path):
    (tmp_path / "six").write_text(SIX)
    edges, vertices = files.read_graph(spark, str(tmp_path / "six"))
    assert rows(edges, "pos", "src", "dst", "weight") == [(i, s, d, 1) for i, (s, d) in enumerate(EDGES)] and vertices.count() == 6


def test_read_adjacency_with_empty_rows(spark, tmp_path):
    (tmp_path / "g").write_text("AdjacencyGraph 5 3 0 0 2 2 2 4 0 1")
    edges, _ = files.read_adjacency(spark, str(tmp_path / "g"))
    assert rows(edges, "src", "dst") == [(1, 0), (1, 4), (4, 1)]


def test_read_adjacency_refuses_wrong_sizes(spark, tmp_path):
    (tmp_path / "g").write_text("AdjacencyGraph 2 3 0 1 1")
    with pytest.raises(ValueError):
        files.read_adjacency(spark, str(tmp_path / "g"))
    (tmp_path / "h").write_text("Graph 1 0 0")
    with pytest.raises(ValueError):
        files.read_adjacency(spark, str(tmp_path / "h"))


@pytest.mark.parametrize("weighted", [False, True])
def test_adjacency_round_trip(spark, tmp_path, weighted):
    edges = spark.createDataFrame([(s, d, w) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)], "src long, dst long, weight long")
    files.write_adjacency(edges, spark.range(6).select("id"), str(tmp_path / "out"), weighted)
    back, vertices = files.read_adjacency(spark, str(tmp_path / "out"))
    assert rows(back, "src", "dst", "weight") == [(s, d, w if weighted else 1) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)] and vertices.count() == 6


@pytest.mark.parametrize("weighted", [False, True])
def test_edge_array_round_trip(spark, tmp_path, weighted):
    edges = spark.createDataFrame([(s, d, w) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)], "src long, dst long, weight long")
    files.write_edge_array(edges, str(tmp_path / "out"), weighted)
    back = files.read_edge_array(spark, str(tmp_path / "out"))
    assert rows(back, "src", "dst", "weight") == [(s, d, w if weighted else 1) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)]


def test_weights_are_cut_to_whole_numbers(spark, tmp_path):
    (tmp_path / "g").write_text("WeightedEdgeArray\n0 1 2.9\n1 0 3\n")
    assert rows(files.read_edge_array(spark, str(tmp_path / "g")), "src", "dst", "weight") == [(0, 1, 2), (1, 0, 3)]


@pytest.mark.parametrize("weighted", [False, True])
def test_galois_round_trip(spark, tmp_path, weighted):
    edges = spark.createDataFrame([(s, d, w) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)], "src long, dst long, weight long")
    path = str(tmp_path / "g.bin")
    files.write_galois(edges, spark.range(6).select("id"), path, weighted)
    back, vertices = files.read_galois(spark, path)
    assert rows(back, "src", "dst", "weight") == [(s, d, w if weighted else 1) for (s, d), w in zip(EDGES, WEIGHTS, strict=True)] and vertices.count() == 6


def test_snap_and_matrix_market(spark, tmp_path):
    (tmp_path / "s").write_text("# a\n# b\n0\t3\n2 1\n")
    edges, n = files.read_snap(spark, str(tmp_path / "s"))
    assert rows(edges, "src", "dst") == [(0, 3), (2, 1)] and n == 4
    (tmp_path / "m").write_text("%%MatrixMarket\n% c\n3 4 3\n1 1 2.5\n3 4 0\n2 3 -1\n")
    entries, size = files.read_matrix_market(spark, str(tmp_path / "m"))
    assert rows(entries, "row", "col", "val") == [(0, 0, 2.5), (1, 2, -1.0)] and size == (3, 4)


def test_matrix_market_size_line_in_the_smallest_part(spark, tmp_path):
    (tmp_path / "part-00000.txt").write_text("%%MatrixMarket\n9 9 41\n1 1 2.5\n")
    (tmp_path / "part-00001.txt").write_text("".join(f"{k % 9 + 1} {k % 7 + 1} 48.0\n" for k in range(40)))
    entries, size = files.read_matrix_market(spark, str(tmp_path))
    assert rows(entries, "row", "col", "val") == sorted([(0, 0, 2.5), *((k % 9, k % 7, 48.0) for k in range(40))]) and size == (9, 9)


def test_binary_layouts(spark, tmp_path):
    base = str(tmp_path / "t")
    with open(f"{base}.config", "w") as f:
        f.write("3\n")
    np.array([1, 2, 0], "<u4").tofile(f"{base}.adj")
    np.array([2, 2, 3], "<i8").tofile(f"{base}.idx")
    edges, _ = files.read_three_files(spark, base)
    assert rows(edges, "src", "dst") == [(0, 1), (0, 2), (2, 0)]
    path = tmp_path / "csr"
    path.write_bytes(struct.pack("<3q", 2, 3, 3) + np.array([1.5, 2, 3], "<f8").tobytes() + np.array([0, 2, 1], "<i8").tobytes() + np.array([0, 2], "<i8").tobytes())
    assert rows(files.read_csr_binary(spark, str(path)), "row", "col", "val") == [(0, 0, 1.5), (0, 2, 2.0), (1, 1, 3.0)]


def test_integers_and_edge_binary(spark, tmp_path):
    files.write_integers(spark.createDataFrame([(0, 7), (1, -3), (2, 9)], "at long, value long"), str(tmp_path / "i"))
    assert rows(files.read_integers(spark, str(tmp_path / "i")), "at", "value") == [(0, 7), (1, -3), (2, 9)]
    files.write_edge_binary(spark.createDataFrame(EDGES, "src long, dst long"), str(tmp_path / "e"))
    assert np.fromfile(tmp_path / "e", "<i8").reshape(-1, 2).tolist() == [list(e) for e in EDGES]


def test_number_text(spark):
    got = spark.range(1).select(files.number_text(F.lit(1234.5), "double").alias("d"), files.number_text(F.lit(12), "long").alias("l")).first()
    assert tuple(got) == ("1.23450000000e+03", "12")


def test_matrix_market_snap_and_numbers_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([(0, 2, 1.5), (1, 0, -2.0), (2, 2, 4.0)], "row long, col long, val double")
    files.write_matrix_market(entries, 3, 4, str(tmp_path / "m"))
    back, size = files.read_matrix_market(spark, str(tmp_path / "m"))
    assert rows(back, "row", "col", "val") == [(0, 2, 1.5), (1, 0, -2.0), (2, 2, 4.0)] and size == (3, 4)
    edges, vertices = files.read_graph(spark, str(tmp_path / "m"), "matrix_market")
    assert rows(edges, "src", "dst") == [(0, 2), (1, 0), (2, 2)] and vertices.count() == 4
    files.write_snap(edges, str(tmp_path / "s"))
    assert rows(files.read_snap(spark, str(tmp_path / "s"))[0], "src", "dst") == [(0, 2), (1, 0), (2, 2)]
    files.write_numbers(spark.createDataFrame([(0, 0.5), (1, 3.0)], "at long, value double"), str(tmp_path / "n"))
    assert [r.value for r in spark.read.text(str(tmp_path / "n")).collect()] == ["5.00000000000e-01", "3.00000000000e+00"]


def test_conversions(spark, tmp_path):
    (tmp_path / "snap").write_text("# a comment\n0\t1\n1\t2\n0\t1\n2\t2\n")
    convert.snap_to_adjacency(spark, str(tmp_path / "snap"), str(tmp_path / "once"))
    convert.snap_to_adjacency(spark, str(tmp_path / "snap"), str(tmp_path / "both"), symmetric=True)
    assert rows(files.read_adjacency(spark, str(tmp_path / "once"))[0], "src", "dst") == [(0, 1), (1, 2), (2, 2)]
    assert rows(files.read_adjacency(spark, str(tmp_path / "both"))[0], "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    (tmp_path / "six").write_text(SIX)
    convert.adjacency_to_galois(spark, str(tmp_path / "six"), str(tmp_path / "six.gr"))
    convert.galois_to_adjacency(spark, str(tmp_path / "six.gr"), str(tmp_path / "again"))
    assert rows(files.read_adjacency(spark, str(tmp_path / "again"))[0], "src", "dst") == sorted(EDGES)
    convert.transpose_adjacency(spark, str(tmp_path / "six"), str(tmp_path / "turned"))
    assert rows(files.read_adjacency(spark, str(tmp_path / "turned"))[0], "dst", "src") == sorted(EDGES)
    convert.weigh_adjacency(spark, str(tmp_path / "six"), str(tmp_path / "weighed"))
    assert all(0 <= r.weight < 20 for r in files.read_adjacency(spark, str(tmp_path / "weighed"))[0].collect())
    mapping = {r.old_id: r.new_id for r in convert.reorder_adjacency(spark, str(tmp_path / "six"), str(tmp_path / "ordered"), parts=2).collect()}
    assert rows(files.read_adjacency(spark, str(tmp_path / "ordered"))[0], "src", "dst") == sorted((mapping[s], mapping[d]) for s, d in EDGES)
