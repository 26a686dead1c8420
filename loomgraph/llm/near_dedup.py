"""Near duplicates by MinHash, banding and sequential Bayesian verification.

1. Every text becomes the set of its word shingles (64-bit hashes of all of them) and a MinHash signature. Texts with
   the same set are one class from here on, represented by its least id.
2. Bands of the signature deal the representatives to buckets. In a bucket all are compared with its least member; a
   bucket whose members are linked already is done. Of the others, texts that share too few shingles with all other
   texts left to be linked with any go out, and the rest are compared with the bucket's most central member. The texts
   that still stand in buckets of several components go through an exact prefix join, which skips what one component
   has in common. So a group of copies costs comparisons in proportion to its size, and no link between components is
   lost.
3. A candidate pair's signatures are compared batch by batch. With a uniform prior on the similarity, the posterior
   probability of reaching the threshold after m agreements in n is a binomial tail; a pair below ``MISS`` is pruned.
4. Survivors are verified exactly on the full sets, and the verified links give the components.

There are as many bands of ``ROWS`` hashes as it takes to miss a pair at the threshold itself with a probability
below ``MISS``: 28 for a similarity of 0.85, 41 for 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stars import star_components
from .bpe import blocks
from .common import by_ids, id_text, lean, materialize, read_documents, release

ROWS = 5
MISS = 1e-7
#: A bucket is compared with one member, its least and then its most central one, before the rest is joined on prefixes.
PIVOT_ROUNDS = 2

_RNG = np.random.default_rng(20240601)
_FACTORS = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64)


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words the whole sequence is one."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z and splits at \x20 \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    acc = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        acc = _mix(acc + h[k : k + len(acc)] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
    return np.unique(acc)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least value of each of ``size`` hash functions over the set (upper 32 bits)."""
    factors, shifts = _FACTORS[:size], _SHIFTS[:size]
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512, None] * factors + shifts
        np.minimum(least, part.min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_agreements(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:  # a batch is one hash of every band
    """(hashes compared, least agreements to go on): below it P(similarity >= threshold | data) < miss.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), whose upper tail is P(Bin(n + 1, t) <= m).
    """
    batch, out = bands_for(threshold), []
    for n in range(batch, ROWS * batch + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def profiles(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set; null for the empty set) and sig, one row per row."""
    size = ROWS * bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sizes, keys, sigs = [], [], []
            for text in block["text"].to_pylist():
                s = shingles(text, width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, size).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return id_text(docs).mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u4").reshape(batch.num_rows, -1, ROWS).astype(np.uint64)
        bands = sigs.shape[1]
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sigs.shape[:2])
        for k in range(ROWS):
            key = _mix(key + sigs[:, :, k] * np.uint64(0xD6E8FEB86659FD93))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(batch["id"].to_numpy(), bands))], ["key", "id"])


def _prune(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs that sequential comparison of signature batches does not rule out."""
    bounds = least_agreements(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            live, agreed, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in bounds:
                agreed[live] += (x[live, done:n] == y[live, done:n]).sum(1)
                live, done = live[agreed[live] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(live))

    of = lambda side: reps.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    needed = materialize(pairs.select("a").distinct().union(pairs.select("b").distinct()).toDF("id").distinct(), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array([shingles(t, width).tobytes() for t in block["text"].to_pylist()], pa.binary())], ["id", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["s_a"], batch["s_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = materialize(id_text(by_ids(docs, needed)).mapInArrow(lean(sets), "id long, s binary"), "sets")
    of = lambda side: held.select(F.col("id").alias(side), F.col("s").alias(f"s_{side}"))
    links = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "s_a", "s_b").mapInArrow(lean(run), "a long, b long").distinct()
    links = materialize(links, "links")
    release(held, needed)
    return links


def _shingle_rows(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, h, size): a row per shingle of the texts with these ids, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            sets = [shingles(t, width) for t in block["text"].to_pylist()]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([block["doc_id"].take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(sizes, sizes).astype(np.int64))], ["id", "h", "size"])

    return materialize(id_text(by_ids(docs, ids)).dropDuplicates(["doc_id"]).mapInArrow(lean(run), "id long, h long, size long"), "shingles")


def _centrality(rest: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, size, shared): shingles of every text left, and how many of them any other text left has, too."""
    ids = materialize(rest.select("id").distinct(), "left")
    held = _shingle_rows(ids, docs, width)
    common = held.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
    shared = materialize(held.join(common, "h").groupBy("id").agg(F.max("size").alias("size"), F.count("*").alias("shared")), "central")
    release(held, ids)
    return shared


def _rest_pairs(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): every pair of different components among the texts left that may reach the threshold.

    An exact join on prefixes: with shingles ordered from the rarest on, linked texts share one of their first
    size - need + 1, and at the first that they share enough must be left behind it in both. In a shingle's list only
    members outside its commonest component look for partners, so large groups aren't compared with themselves.
    """
    left = materialize(rows.select("id", "component").distinct(), "left")
    held = _shingle_rows(left.select("id"), docs, width)
    counts = held.groupBy("h").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("id").orderBy("_n", "h")
    placed = held.join(counts, "h").withColumn("at", F.row_number().over(order) - 1)
    need = F.ceil(F.col("size") * percent / F.lit(100))
    prefix = materialize(placed.where((F.col("at") <= F.col("size") - need) & (F.col("_n") > 1)).join(left, "id").select("h", "id", "component", "size", "at"), "prefixes")
    groups = prefix.groupBy("h", "component").agg(F.count("*").alias("n"))
    large = groups.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("_large"))
    names = ("component", "size", "at")
    x = prefix.join(large, "h").where("component <> _large").select("h", F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in names))
    y = prefix.select("h", F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in names))
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = (100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))
    close = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    met = x.join(y, (x["h"] == y["h"]) & (F.col("component_a") != F.col("component_b")) & enough & close)
    pairs = materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    release(left, held, prefix)
    return pairs


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, component, ...) of the buckets that hold more than one component."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("key")
    return materialize(rows.join(mixed, "key"), "mixed")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets. Null, empty and word-less texts
    have the empty set and are linked with nothing. component_id is the least doc_id reachable; doc_id identifies a
    text (rows repeated whole get equal results). A row without doc_id is no representative: alone in its class it has
    a null component_id and stays.
    """
    docs = docs.select("doc_id", "text")
    profile = materialize(profiles(docs, width, percent / 100), "profiles")
    classes = profile.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    reps = materialize(classes.select("set_key", F.col("rep").alias("id"), "sig"), "reps")
    banded = reps.select("id", "sig").mapInArrow(lean(_bands), "key long, id long")
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).where("pivot <> _last").drop("_last")
    rows = materialize(banded.join(shared, "key"), "buckets")  # only buckets of two and more
    labels = central = None
    for number in range(PIVOT_ROUNDS + 1):
        if number < PIVOT_ROUNDS:
            pairs = rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        else:
            pairs = _rest_pairs(rows, docs, width, percent)
        found = _verify(materialize(_prune(pairs, reps, percent / 100), "survivors"), docs, width, percent)
        if labels is None:
            labels = materialize(star_components(found), "labels")
        elif not found.isEmpty():
            # what is linked already goes on as stars
            held = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = materialize(star_components(held.unionByName(found)), "labels")
        if number == PIVOT_ROUNDS:
            break
        # what a pivot was compared with is settled; others go on where a bucket still holds several components
        rest = rows.where("id <> pivot").select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        rest = _mixed(rest)
        if central is None:
            central = _centrality(rest, docs, width)
        # a text shares with any other at most what it shares with all others together
        open_ = _mixed(rest.join(central.where(100 * F.col("shared") >= percent * F.col("size")), "id"))
        middle = open_.groupBy("key").agg(F.max_by("id", F.struct(F.col("shared") / F.col("size"), -F.col("id"))).alias("pivot"))
        rows = materialize(open_.select("key", "id", "component").join(middle, "key"), "buckets")
        if rows.isEmpty():
            break
    named = reps.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("_component"))
    joined = profile.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: one of each group of near duplicates, with all their columns."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    return by_ids(docs, materialize(gone, "gone"), "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), width=3, percent=85)
