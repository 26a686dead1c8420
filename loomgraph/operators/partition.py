"""Partitioning and ordering of vertices and edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import prefix_scan
from ..plans.state import cut
from .prep import relabel


def vertex_balanced(vertices: DataFrame, n: int, parts: int) -> DataFrame:
    """id, part: ranges of n div parts ids, the remainder in the last; ids are 0..n-1."""
    return vertices.select("id", F.least(F.floor(F.col("id") / F.lit(max(1, n // parts))), F.lit(parts - 1)).cast("int").alias("part"))


def edge_balanced(degrees: DataFrame, parts: int) -> DataFrame:
    """id, part: ranges of about m / parts edges; ``degrees`` is (id, degree). Parts may be empty."""
    scanned = prefix_scan(degrees, ["id"], F.col("degree"), "before", inclusive=False)
    m = degrees.agg(F.sum("degree").alias("m"))
    return scanned.crossJoin(F.broadcast(m)).select("id", F.least(F.floor(F.col("before") * parts / F.greatest("m", F.lit(1))), F.lit(parts - 1)).cast("int").alias("part"))


def greedy_ranges(degrees: DataFrame, parts: int) -> DataFrame:
    """id, part by the greedy rule: a range closes once it has the mean number of edges, or early when the next vertex
    would lift it over 1.1 times the mean.

    Both conditions are monotone in the running degree, so each range end is one search in the scanned table.
    """
    scanned = cut(prefix_scan(degrees, ["id"], F.col("degree"), "upto"))
    mean = (scanned.agg(F.max("upto")).first()[0] or 0) // parts
    ends: list[int] = []
    base = 0
    last = scanned.agg(F.max("id")).first()[0]
    after = cut(prefix_scan(scanned, ["id"], F.col("upto"), "next_upto", fold="last", inclusive=False, backward=True))
    for _ in range(parts - 1):
        full = F.col("upto") - base >= mean
        close = F.col("next_upto") - base > 1.1 * mean
        start = ends[-1] + 1 if ends else -(1 << 62)
        row = after.where((F.col("id") >= start) & (full | close)).agg(F.min(F.struct("id", "upto")).alias("e")).first()["e"]
        if row is None or row["id"] == last:
            break
        ends.append(row["id"])
        base = row["upto"]
    part = F.lit(0)
    for e in ends:
        part = part + F.when(F.col("id") > e, 1).otherwise(0)
    return scanned.select("id", part.cast("int").alias("part"))


def rising_ranges(degrees: DataFrame, parts: int) -> DataFrame:
    """id, part: a new part wherever the degree rises from one id to the next (``degrees``: id, degree)."""
    before = prefix_scan(degrees, ["id"], F.col("degree"), "_before", fold="last", inclusive=False)
    rises = F.when(F.col("degree") > F.col("_before"), 1).otherwise(0).cast("long")
    return prefix_scan(before, ["id"], rises, "_rises").select("id", F.least("_rises", F.lit(parts - 1)).cast("int").alias("part"))


def edges_by(edges: DataFrame, ranges: DataFrame, end: str = "dst") -> DataFrame:
    """Edges with the part of their destination (or source), dealt and sorted by it."""
    held = edges.join(ranges.select(F.col("id").alias(end), "part"), end)
    return held.repartition("part").sortWithinPartitions("part", end)


def map_parts(edges: DataFrame, ranges: DataFrame, *results: Column, end: str = "dst") -> DataFrame:
    """part and ``results`` (aggregates over a part's edges), one row per part that has edges.

    Partial results fold before they move, so a part with most of the edges is no task of its own.
    """
    first, *rest = results
    return edges.join(ranges.select(F.col("id").alias(end), "part"), end).groupBy("part").agg(first, *rest)


def sub_graph(edges: DataFrame, low: int, high: int, end: str = "dst") -> DataFrame:
    """Edges whose end lies in [low, high)."""
    return edges.where(F.col(end).between(low, high - 1))


def hilbert_key(x: Column, y: Column, bits: int) -> Column:
    """Distance of (x, y) along the Hilbert curve of side 2^bits, a fold over the bits from the highest."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        bit = lambda v: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("long"))
        rx, ry = bit(s["x"]), bit(s["y"])
        flip = (ry == 0) & (rx == 1)
        px = F.when(flip, F.bitwise_not(s["x"])).otherwise(s["x"])
        py = F.when(flip, F.bitwise_not(s["y"])).otherwise(s["y"])
        quadrant = (3 * rx).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, py).otherwise(px).alias("x"), F.when(ry == 0, px).otherwise(py).alias("y"), (s["d"] * 4 + quadrant).alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"]) if bits else F.lit(0).cast("long")


def hilbert_point(key: Column, bits: int) -> Column:
    """(x, y) as a struct at a distance along the curve, the inverse of ``hilbert_key``: a fold from the lowest bits."""
    zero = F.lit(0).cast("long")

    def step(s: Column, k: Column) -> Column:
        pair = F.call_function("shiftright", key.cast("long"), 2 * k).bitwiseAND(F.lit(3).cast("long"))
        rx, ry = F.when(pair >= 2, 1).otherwise(0), F.when(pair.isin(1, 2), 1).otherwise(0)
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        flip = (ry == 0) & (rx == 1)
        px, py = (F.when(flip, side - 1 - s[c]).otherwise(s[c]) for c in "xy")
        return F.struct((F.when(ry == 0, py).otherwise(px) + side * rx).alias("x"), (F.when(ry == 0, px).otherwise(py) + side * ry).alias("y"))

    start = F.struct(zero.alias("x"), zero.alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step) if bits else start


def hilbert_order(edges: DataFrame, m: int) -> DataFrame:
    """Edges with ``hkey`` on the grid whose side is the least power of two >= m, dealt in ranges and sorted by it."""
    bits = max(0, (m - 1).bit_length()) if m > 1 else 0
    keyed = edges.withColumn("hkey", hilbert_key(F.col("src"), F.col("dst"), bits))
    return keyed.repartitionByRange("hkey").sortWithinPartitions("hkey", "src", "dst")


def _level(loads: list[int], n: int, step: int) -> list[int]:
    """How many of n items of size ``step`` each load gets when every one goes to the least load, the first on ties."""
    parts = len(loads)
    low, high = min(loads), max(loads) + (n // parts + 2) * step
    taken = lambda bar: [max(0, -((x - bar) // step)) if x < bar else 0 for x in loads]  # noqa: E731  items that start below the bar
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(taken(mid)) <= n else (low, mid - 1)
    got = taken(low)
    left = n - sum(got)
    heap = [(x + k * step, j) for j, (x, k) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(left):
        load, j = heap[0]
        got[j] += 1
        heapq.heapreplace(heap, (load + step, j))
    return got


def balance_plan(histogram: dict[int, int], parts: int) -> list[tuple[int, int, int, int]]:
    """(degree, part, first rank within the degree, first new id) from a histogram degree -> vertices.

    Degrees go from high to low, each vertex to the part with the fewest edges so far (computed a whole degree at a
    time); vertices of degree 0 level the parts' sizes. New ids run part by part, in a part from high to low degree.
    """
    edges, sizes = [0] * parts, [0] * parts
    given: list[tuple[int, list[int]]] = []
    for degree in sorted(histogram, reverse=True):
        got = _level(edges, histogram[degree], degree) if degree else _level(sizes, histogram[0], 1)
        for j, k in enumerate(got):
            edges[j] += k * degree
            sizes[j] += k
        given.append((degree, got))
    new = [0, *np.cumsum(sizes[:-1]).tolist()]
    out = []
    for degree, got in given:
        rank = 0
        for j, k in enumerate(got):
            if k:
                out.append((degree, j, rank, new[j]))
                rank += k
                new[j] += k
    return out


def vebo(degrees: DataFrame, parts: int = 384) -> DataFrame:
    """old_id, new_id, part_id: ids reordered so that every part has nearly the same edges and vertices.

    ``degrees`` is (id, degree). Only the degree histogram (at most about sqrt(2 m) rows) reaches the driver; vertices
    find their rank within their degree by a distributed scan.
    """
    spark = degrees.sparkSession
    degrees = cut(degrees)
    histogram = {r["degree"]: r["n"] for r in degrees.groupBy("degree").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for degree in sorted(histogram, reverse=True):
        first[degree] = total
        total += histogram[degree]
    table = np.array([(first[d] + rank, part, new) for d, part, rank, new in balance_plan(histogram, parts)], np.int64).reshape(-1, 3)
    held = spark.sparkContext.broadcast(table)  # rows: degrees times parts at most
    placed = prefix_scan(degrees.withColumn("_down", -F.col("degree")), ["_down", "id"], F.lit(1).cast("long"), "_place", inclusive=False).select("id", "_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            place = batch["_place"].to_numpy()
            at = np.searchsorted(t[:, 0], place, "right") - 1
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(t[at, 2] + place - t[at, 0]), pa.array(t[at, 1].astype(np.int32))], ["old_id", "new_id", "part_id"])

    return placed.mapInArrow(run, "old_id long, new_id long, part_id int")


def vebo_graph(edges: DataFrame, degrees: DataFrame, parts: int = 384) -> DataFrame:
    """``edges`` under the ids that ``vebo`` gives, ready to be written."""
    return relabel(edges, cut(vebo(degrees, parts)).select("old_id", "new_id"))
