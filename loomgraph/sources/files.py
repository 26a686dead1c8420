"""Readers and writers of graph files: adjacency text, edge lists, matrices, binary layouts.

Text is read in splits: every token's place in the file comes from a distributed scan over (file, block, line, place),
so no reader needs a file to fit into one task. Binary layouts are read as whole files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import prefix_scan
from ..operators.prep import edges_from_matrix
from ..plans.state import cut

#: Separators of tokens: CR, TAB, LF, NUL and SPACE.
SEPARATORS = r"[\r\t\n\x00 ]+"
ADJACENCY, WEIGHTED_ADJACENCY = "AdjacencyGraph", "WeightedAdjacencyGraph"
EDGES, WEIGHTED_EDGES, INTEGERS = "EdgeArray", "WeightedEdgeArray", "sequenceInt"
GALOIS_VERSION = 1


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(at, token): all tokens of a text file (or folder of ordered parts) numbered from 0."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("l"), "value")
    tokens = lines.select("f", "b", "l", F.posexplode(F.array_remove(F.split("value", SEPARATORS), "")).alias("k", "token"))
    return prefix_scan(tokens, ["f", "b", "l", "k"], F.lit(1).cast("long"), "at", inclusive=False).select("at", "token")


def read_integers(spark: SparkSession, path: str) -> DataFrame:
    """(at, value) of a file of integers."""
    tokens = cut(read_tokens(spark, path))
    _header(tokens, (INTEGERS,))
    return tokens.where("at > 0").select((F.col("at") - 1).alias("at"), F.col("token").cast("long").alias("value"))


def _header(tokens: DataFrame, known: tuple[str, ...]) -> str:
    row = tokens.where("at = 0").first()
    if row is None or row["token"] not in known:
        raise ValueError(f"the file's first word is none of {known}")
    return row["token"]


def _rows_of(starts: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (pos, ...) with src: the last row whose start (id, start) isn't behind the position.

    Starts and positions are merged into one order and scanned, which replaces a range join.
    """
    rest = [c for c in targets.columns if c != "pos"]
    marks = starts.select(F.col("start").alias("pos"), F.lit(0).alias("kind"), "id", *(F.lit(None).cast("long").alias(c) for c in rest))
    edges = targets.select("pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), *rest)
    both = marks.unionByName(edges).withColumn("_id", F.coalesce("id", F.lit(-1)))
    return prefix_scan(both, ["pos", "kind", "_id"], F.col("id"), "src", fold="max").where("kind = 1").select("src", "pos", *rest)


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of adjacency text, weighted or not; edges are src, dst, weight (1 without weights), pos."""
    tokens = cut(read_tokens(spark, path))
    weighted = _header(tokens, (ADJACENCY, WEIGHTED_ADJACENCY)) == WEIGHTED_ADJACENCY
    sizes = {r["at"]: int(r["token"]) for r in tokens.where("at in (1, 2)").collect()}
    n, m = sizes.get(1, -1), sizes.get(2, -1)
    if tokens.count() != 1 + 2 + n + m * (1 + weighted):
        raise ValueError("the number of words doesn't agree with the sizes the file states")
    numbers = tokens.where("at >= 3").select((F.col("at") - 3).alias("k"), F.col("token").cast("long").alias("v"))
    starts = numbers.where(F.col("k") < n).select(F.col("k").alias("id"), F.col("v").alias("start"))
    targets = numbers.where((F.col("k") >= n) & (F.col("k") < n + m)).select((F.col("k") - n).alias("pos"), F.col("v").alias("dst"))
    if weighted:
        targets = targets.join(numbers.where(F.col("k") >= n + m).select((F.col("k") - n - m).alias("pos"), F.col("v").alias("weight")), "pos")
    else:
        targets = targets.withColumn("weight", F.lit(1).cast("long"))
    return _rows_of(starts, targets).select("src", "dst", "weight", "pos"), spark.range(n).select("id")


def read_edge_array(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight, pos of an edge list with its header; weights are cut to whole numbers."""
    tokens = cut(read_tokens(spark, path))
    width = 3 if _header(tokens, (EDGES, WEIGHTED_EDGES)) == WEIGHTED_EDGES else 2
    k = F.col("at") - 1
    rows = tokens.where("at > 0").groupBy(F.floor(k / width).alias("pos")).agg(*(F.max(F.when(k % width == i, F.col("token"))).alias(c) for i, c in enumerate(("src", "dst", "weight")[:width])))
    weight = F.col("weight").cast("double").cast("long") if width == 3 else F.lit(1).cast("long")
    return rows.select(F.col("src").cast("long"), F.col("dst").cast("long"), weight.alias("weight"), "pos")


def read_snap(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(edges src, dst; greatest id + 1) of a comment-headed edge list."""
    parts = F.array_remove(F.split("value", SEPARATORS), "")
    lines = spark.read.text(path).where("not startswith(value, '#')").select(parts.alias("p")).where(F.size("p") >= 2)
    edges = lines.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))
    return edges, (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """(row, col, val from 0, zeros left out; the matrix's size) of a text file or folder of ordered parts."""
    lines = spark.read.text(path).where("not startswith(value, '%')")
    place = (F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("l"))
    placed = cut(lines.select(*place, F.array_remove(F.split("value", SEPARATORS), "").alias("p")).where(F.size("p") > 0))
    # splits are read by size, so the least l needn't be the first line
    first = placed.orderBy("f", "b", "l").first()
    rows, cols, n = (int(x) for x in first["p"][:3])
    body = placed.where(F.col("l") != first["l"])
    if body.count() != n:
        raise ValueError("the number of entries doesn't agree with the size line")
    entries = body.select((F.col("p")[0].cast("long") - 1).alias("row"), (F.col("p")[1].cast("long") - 1).alias("col"), F.col("p")[2].cast("double").alias("val"))
    return entries.where("val <> 0"), (rows, cols)


_EDGE_SCHEMA = "src long, dst long, weight long, pos long"


def _edges_of(ends: np.ndarray, targets: np.ndarray, weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Edge batches from end offsets."""
    src = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends.astype(np.int64)])))
    w = np.ones(len(targets), np.int64) if weights is None else weights.astype(np.int64)
    for at in range(0, len(targets), 1 << 20):
        part = slice(at, at + (1 << 20))
        pos = np.arange(at, min(len(targets), at + (1 << 20)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src[part], targets[part].astype(np.int64), w[part], pos)], ["src", "dst", "weight", "pos"])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_galois(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of a version 1 binary graph: 64-bit header and end offsets, 32-bit targets padded to an even
    number, 32-bit weights where the header says 4 bytes."""
    head = _whole(spark, path).select(F.substring("content", 1, 32).alias("h")).first()["h"]
    version, _, n, _ = struct.unpack("<4q", bytes(head))
    if version != GALOIS_VERSION:
        raise ValueError(f"binary graph version {version} isn't {GALOIS_VERSION}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"].to_pylist():
                _, width, n, m = struct.unpack_from("<4q", raw)
                ends = np.frombuffer(raw, "<i8", n, 32)
                targets = np.frombuffer(raw, "<u4", m, 32 + 8 * n)
                weights = np.frombuffer(raw, "<u4", m, 32 + 8 * n + 4 * (m + m % 2)) if width == 4 else None
                yield from _edges_of(ends, targets, weights)

    return _whole(spark, path).mapInArrow(run, _EDGE_SCHEMA), spark.range(n).select("id")


def read_three_files(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of ``base``.config (vertices), .adj (32-bit targets) and .idx (64-bit end offsets)."""
    n = int(spark.read.text(f"{base}.config").first()[0].split()[0])
    both = _whole(spark, f"{base}.adj").select(F.col("content").alias("adj")).crossJoin(_whole(spark, f"{base}.idx").select(F.col("content").alias("idx")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for adj, idx in zip(batch["adj"].to_pylist(), batch["idx"].to_pylist(), strict=True):
                yield from _edges_of(np.frombuffer(idx, "<i8", n), np.frombuffer(adj, "<u4"), None)

    return both.mapInArrow(run, _EDGE_SCHEMA), spark.range(n).select("id")


def read_csr_binary(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val of a binary sparse matrix: 64-bit rows, columns and entries; double values, column ids, starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["content"].to_pylist():
                rows, _, n = struct.unpack_from("<3q", raw)
                values = np.frombuffer(raw, "<f8", n, 24)
                cols = np.frombuffer(raw, "<i8", n, 24 + 8 * n)
                starts = np.append(np.frombuffer(raw, "<i8", rows, 24 + 16 * n), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows), np.diff(starts))), pa.array(cols), pa.array(values)], ["row", "col", "val"])

    return _whole(spark, path).mapInArrow(run, "row long, col long, val double")


def _matrix_side(spark: SparkSession, path: str) -> int:
    head = _whole(spark, path).select(F.substring("content", 1, 16).alias("h")).first()["h"]
    return max(struct.unpack("<2q", bytes(head)))


def read_graph(spark: SparkSession, path: str, fmt: str = "adjacency") -> tuple[DataFrame, DataFrame]:
    if fmt in ("adjacency", "text"):
        return read_adjacency(spark, path)
    if fmt in ("galois", "binary"):
        return read_galois(spark, path)
    if fmt == "snap":
        edges, n = read_snap(spark, path)
        return edges, spark.range(n).select("id")
    if fmt == "edges":
        edges = read_edge_array(spark, path)
        return edges, spark.range((edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1).select("id")
    if fmt == "three":
        return read_three_files(spark, path)
    if fmt in ("matrix_market", "csr"):
        if fmt == "csr":
            entries, n = read_csr_binary(spark, path), _matrix_side(spark, path)
        else:
            entries, size = read_matrix_market(spark, path)
            n = max(size)
        return edges_from_matrix(entries).withColumn("weight", F.lit(1).cast("long")), spark.range(n).select("id")
    raise ValueError(f"unknown format {fmt}")


def _write_lines(parts: list[DataFrame], path: str) -> None:
    """Write tables of (line, at) one behind another as a folder of ordered text parts."""
    every = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("_k"), F.col("at").cast("long").alias("_at"), F.col("line").cast("string").alias("value"))
        every = p if every is None else every.unionByName(p)
    every.repartitionByRange("_k", "_at").sortWithinPartitions("_k", "_at").select("value").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, *values: object) -> DataFrame:
    return spark.createDataFrame([(str(v), i) for i, v in enumerate(values)], "line string, at long")


def write_adjacency(edges: DataFrame, vertices: DataFrame, path: str, weighted: bool = False, header: str | None = None) -> None:
    """Adjacency text: header, n, m, start offsets, targets and, where asked for, weights. Ids are 0..n-1."""
    spark = edges.sparkSession
    edges = cut(prefix_scan(edges.select("src", "dst", "weight") if "weight" in edges.columns else edges.select("src", "dst", F.lit(1).cast("long").alias("weight")), ["src", "dst", "weight"], F.lit(1).cast("long"), "at", inclusive=False))
    degrees = vertices.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left")
    starts = prefix_scan(degrees, ["id"], F.coalesce("d", F.lit(0)), "start", inclusive=False)
    head = header or (WEIGHTED_ADJACENCY if weighted else ADJACENCY)
    parts = [_lines(spark, head, vertices.count(), edges.count()), starts.select(F.col("start").alias("line"), F.col("id").alias("at")), edges.select(F.col("dst").alias("line"), "at")]
    _write_lines(parts + ([edges.select(F.col("weight").alias("line"), "at")] if weighted else []), path)


def write_edge_array(edges: DataFrame, path: str, weighted: bool = False) -> None:
    names = ["src", "dst", *["weight"] * weighted]
    placed = prefix_scan(edges.select(*names), names, F.lit(1).cast("long"), "at", inclusive=False)
    _write_lines([_lines(edges.sparkSession, WEIGHTED_EDGES if weighted else EDGES), placed.select(F.concat_ws(" ", *names).alias("line"), "at")], path)


def write_matrix_market(entries: DataFrame, rows: int, cols: int, path: str) -> None:
    """``entries`` (row, col, val; from 0) with the size line, in (row, col) order."""
    placed = cut(prefix_scan(entries.select("row", "col", "val"), ["row", "col"], F.lit(1).cast("long"), "at", inclusive=False))
    head = _lines(entries.sparkSession, "%%MatrixMarket matrix coordinate real general", f"{rows} {cols} {placed.count()}")
    _write_lines([head, placed.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("line"), "at")], path)


def write_snap(edges: DataFrame, path: str) -> None:
    """Lines of src and dst between tabs, behind a comment line."""
    placed = prefix_scan(edges.select("src", "dst"), ["src", "dst"], F.lit(1).cast("long"), "at", inclusive=False)
    _write_lines([_lines(edges.sparkSession, "# FromNodeId\tToNodeId"), placed.select(F.concat_ws("\t", "src", "dst").alias("line"), "at")], path)


def write_numbers(values: DataFrame, path: str, kind: str = "double") -> None:
    """``values`` (at, value) one a line in the text form of ``kind``, without a header."""
    _write_lines([values.select(number_text(F.col("value"), kind).alias("line"), "at")], path)


def write_integers(values: DataFrame, path: str) -> None:
    """``values`` (at, value) as a file of integers."""
    _write_lines([_lines(values.sparkSession, INTEGERS), values.select(F.col("value").alias("line"), "at")], path)


def number_text(x: Column, kind: str) -> Column:
    """Numbers as text: whole numbers plainly, doubles with 11 decimals and an exponent."""
    return F.format_string("%.11e" if kind == "double" else "%d", x)


def write_edge_binary(edges: DataFrame, path: str) -> None:
    """Raw (src, dst) pairs of 64-bit integers in order; Arrow batches go to the file one at a time."""
    with open(path, "wb") as f:
        for row in edges.select("src", "dst").orderBy("src", "dst").toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack("<2q", row["src"], row["dst"]))


def write_galois(edges: DataFrame, vertices: DataFrame, path: str, weighted: bool = False) -> None:
    """The binary layout that ``read_galois`` reads. Ids must fit 32 bits; partitions stream through the driver."""
    n, m = vertices.count(), edges.count()
    if n > 1 << 32:
        raise ValueError("ids exceed 32 bits")
    edges = cut(edges.select("src", "dst", F.col("weight") if "weight" in edges.columns else F.lit(1).cast("long").alias("weight")))
    degrees = vertices.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left")
    ends = prefix_scan(degrees, ["id"], F.coalesce("d", F.lit(0)), "end").orderBy("id")
    order = edges.orderBy("src", "dst", "weight")
    with open(path, "wb") as f:
        f.write(struct.pack("<4q", GALOIS_VERSION, 4 if weighted else 0, n, m))
        for row in ends.select("end").toLocalIterator():
            f.write(struct.pack("<q", row["end"]))
        for row in order.select("dst").toLocalIterator():
            f.write(struct.pack("<I", row["dst"]))
        f.write(b"\0" * (4 * (m % 2)))
        if weighted:
            for row in order.select("weight").toLocalIterator():
                f.write(struct.pack("<I", row["weight"]))
