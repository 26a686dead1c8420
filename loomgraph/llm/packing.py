"""Best-two-fit packing of token sequences.

A bin is filled greedily (always the longest piece that still fits); then its smallest piece is exchanged for two
unpacked pieces whenever a pair fills the widened gap more tightly.

Which pieces are where only matters through their lengths, and there are at most ``capacity`` lengths. So the plan is
made on the histogram of lengths: a bin's pattern repeats until one of its lengths runs short, and is taken that many
times at once. Every such step uses up a length or a remainder of one, so the plan's size is bounded by the capacity,
not by the corpus. The pieces are then numbered within their length (in hashed buckets, whose offsets are summed up
apart, so that no length's pieces meet in one task) and find bin and offset from their number.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CUT_CHARS, blocks, tokenizer_path, vocabulary
from .common import id_text, lean, materialize, partitions, read_documents

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are numbered together, about.
BUCKET_ROWS = 20_000

def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every document's ids, an end id behind them.

    Null and empty texts are the end id alone. Only documents longer than ``capacity`` are cut. Repeated rows stay.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        end = END_ID.to_bytes(4, "little")
        for block in blocks(batches, "text", CUT_CHARS):
            rows = []
            for doc, ids in zip(block["doc_id"].to_pylist(), words.encode(block["text"].to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

    return id_text(docs).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of every bin pattern, for a histogram length -> pieces.

    Each step either empties a length or leaves less of it than a pattern takes, so there are few patterns for any
    number of pieces.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    below = np.zeros(capacity + 1, np.int64)  # the longest length with pieces, up to each index
    index = np.arange(capacity + 1)

    def longest_up_to() -> np.ndarray:
        np.maximum.accumulate(np.where(count > 0, index, 0), out=below)
        return below

    made = []
    while longest_up_to()[capacity]:
        had, bin_, gap = {}, [], capacity
        while gap and (length := int(below[gap])):
            had.setdefault(length, int(count[length]))
            n = min(gap // length, int(count[length]))
            bin_ += [length] * n
            count[length] -= n
            gap -= n * length
            if not count[length]:
                longest_up_to()
        if gap and len(bin_) > 1:
            small, wide = bin_[-1], gap + bin_[-1]
            longest_up_to()
            low = np.arange(1, wide // 2 + 1)
            low = low[count[low] > 0]
            high = below[wide - low]
            # a pair of one length needs two pieces of it; otherwise the next shorter one is tried
            single = (high == low) & (count[low] < 2)
            high = np.where(single, 0, high)
            both = np.where(high >= low, low + high, 0)
            if len(both) and both.max() > small:
                a = int(low[both.argmax()])
                b = int(high[both.argmax()])
                bin_.pop()
                count[small] += 1
                for x in (a, b):
                    had.setdefault(x, int(count[x]))
                    count[x] -= 1
                bin_ += [b, a]
        uses = Counter(bin_)
        for x, n in had.items():
            count[x] = n
        times = min(int(count[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            count[x] -= times * n
        made.append((times, bin_))
    return made


def _places(patterns: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of pieces of one length in one pattern, in order: its key (length and first number), times used per
    bin, first sequence and offset."""
    numbered: Counter = Counter()
    rows, sequence = [], 0
    for times, bin_ in patterns:
        at = 0
        for length, n in sorted(Counter(bin_).items(), reverse=True):
            rows.append((length << 44 | numbered[length], n, sequence, at))
            numbered[length] += times * n
            at += n * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "n", "sequence", "offset"), table.T.copy(), strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a materialised table with doc_id, piece, start, length) with sequence_id and offset.

    Sequences are numbered from 0 and gapless inside; an empty table gives an empty result.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity), capacity))
    buckets = max(1, total // BUCKET_ROWS)
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    numbered = bucketed.withColumn("_own", F.row_number().over(own) - 1).join(offsets, ["length", "_bucket"]).withColumn("_number", F.col("_before") + F.col("_own")).drop("_before", "_own", "_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch["length"].to_numpy()
            key = length << 44 | batch["_number"].to_numpy()
            at = np.searchsorted(p["key"], key, "right") - 1
            copy, slot = np.divmod(key - p["key"][at], p["n"][at])
            kept = batch.drop_columns(["_number"])
            yield kept.append_column("sequence_id", pa.array(p["sequence"][at] + copy)).append_column("offset", pa.array(p["offset"][at] + slot * length))

    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids."""
    return pack(materialize(pieces(docs, path, capacity, with_ids), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
