"""Exact deduplication through a sharded cuckoo-filter index.

Digests (SHA-256 of the whole normalised text) are dealt to shards by their leading bits. Each shard holds one cuckoo
filter: short fingerprints in two candidate buckets. A miss proves a digest new; a hit is verified against the stored
keys of the same bucket pair, so false positives cost one comparison and never a wrong answer. What is known of a digest
(the document that stays, the live rows) lies in its slot. Overflow (a kick chain too long) doubles the table and
re-inserts from the stored keys. Digests are taken out again when their last live row goes.

Copies are folded where they are read (one row per digest and input batch), so a digest that a third of all rows
share reaches its shard as one row per batch. There are as many shards as it takes for ``SHARD_ROWS`` rows each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, fresh, id_text, lean, materialize, partitions, read_documents

SLOTS = 4
MAX_KICKS = 200
#: Rows of a shard, about; its index takes some 250 bytes a row at most.
SHARD_ROWS = 250_000


class CuckooIndex:
    """A cuckoo filter over digests with the keys stored beside the fingerprints.

    ``find`` looks at two buckets of ``SLOTS`` fingerprints, and at a stored key only where a fingerprint agrees.
    """

    def __init__(self, capacity: int = 1024):
        self.n_buckets = 1 << max(2, (max(1, capacity) // SLOTS).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.fingerprints = [0] * (self.n_buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (self.n_buckets * SLOTS)
        self.values: list = [None] * (self.n_buckets * SLOTS)
        self.size = 0
        self.resizes = getattr(self, "resizes", 0)
        self.false_hits = getattr(self, "false_hits", 0)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(key[-2:], "little") | 1 << 16  # never 0, which marks a free slot
        first = int.from_bytes(key[8:16], "little") & (self.n_buckets - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 >> 7 & (self.n_buckets - 1))

    def find(self, key: bytes) -> int:
        """The slot that holds ``key``, or -1."""
        fingerprint, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.fingerprints[slot] == fingerprint:
                    if self.keys[slot] == key:
                        return slot
                    self.false_hits += 1
        return -1

    def __contains__(self, key: bytes) -> bool:
        return self.find(key) >= 0

    def insert(self, key: bytes, value: object = None) -> bool:
        """True if ``key`` was new; the value of a key that is held already stays."""
        if self.find(key) >= 0:
            return False
        while not self._place(key, value):
            self._grow()
        return True

    def _place(self, key: bytes, value: object) -> bool:
        fingerprint, first, second = self._places(key)
        bucket = first
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprints[slot]:
                    self.fingerprints[slot], self.keys[slot], self.values[slot] = fingerprint, key, value
                    self.size += 1
                    return True
        undo = []
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + fingerprint) % SLOTS
            undo.append(slot)
            fingerprint, self.fingerprints[slot] = self.fingerprints[slot], fingerprint
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, fingerprint)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.fingerprints[free]:
                    self.fingerprints[free], self.keys[free], self.values[free] = fingerprint, key, value
                    self.size += 1
                    return True
        for slot in reversed(undo):  # nothing that was stored is lost when the chain fails
            fingerprint, self.fingerprints[slot] = self.fingerprints[slot], fingerprint
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
        return False

    def _grow(self) -> None:
        stored = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None]
        while True:
            self.n_buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._place(k, v) for k, v in stored):
                return

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.fingerprints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True


_CLASSES = "digest binary, keep_id long, group_size long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest and batch, before the shuffle."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "max"), ("doc_id", "count"), ("digest", "count")])
        yield from pa.table({"digest": table["digest"], "keep_id": table["doc_id_max"].cast(pa.int64()), "group_size": table["digest_count"].cast(pa.int64())}).to_batches()


def _index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run one shard's folded rows through its cuckoo index; one row per live digest.

    A row of a negative size takes that many rows of the document ``keep_id`` out. Where that document was the one that
    stays, keep_id comes out null and ``open`` true.
    """
    index = CuckooIndex()
    for batch in batches:
        for key, keep, n in zip(batch["digest"].to_pylist(), batch["keep_id"].to_pylist(), batch["group_size"].to_pylist(), strict=True):
            slot = index.find(key)
            if slot < 0:
                if n > 0:
                    index.insert(key, [keep, n, False])
                continue
            held = index.values[slot]
            held[1] += n
            if held[1] <= 0:  # the last live row went
                index.delete(key)
            elif n < 0:
                held[2] = held[2] or keep == held[0]
            elif held[0] is None or keep is not None and keep > held[0]:
                held[0] = keep
    live = [(k, *v) for k, v in zip(index.keys, index.values, strict=True) if k is not None]
    for at in range(0, len(live), 10_000):
        part = live[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([None if r[3] else r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.bool_())], ["digest", "keep_id", "group_size", "open"])


def digests(docs: DataFrame, normalised: Column | None = None) -> DataFrame:
    """``doc_id`` and the 32-byte SHA-256 of each whole (normalised) text."""
    d = id_text(docs)
    return d.select("doc_id", F.unhex(F.sha2((normalised if normalised is not None else F.col("text")).cast("binary"), 256)).alias("digest"))


def _shards(rows: DataFrame) -> int:
    return max(partitions(rows.sparkSession), math.ceil(rows.count() / SHARD_ROWS))


def build_index(keyed: DataFrame, shards: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size), one row per distinct digest of the table ``keyed`` (doc_id, digest)."""
    folded = keyed.select("doc_id", "digest").mapInArrow(lean(_fold), _CLASSES)
    return folded.repartition(shards or _shards(keyed), "digest").mapInArrow(lean(_index_shard), _CLASSES + ", open boolean").drop("open")


def update_index(index: DataFrame, members: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """The index after new documents came and others went (both doc_id, digest).

    ``members`` (doc_id, digest) are the documents of ``index``. Deletions are retractions: a digest whose last live row
    goes leaves the filter; where the document that stays goes, the largest doc_id that is left takes its place. What
    was never inserted is not taken out.
    """
    change = lambda rows, n: rows.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.lit(n).cast("long").alias("group_size"))
    rows, left = index.select("digest", "keep_id", "group_size").withColumn("o", F.lit(0)), members.select("doc_id", "digest")
    if inserts is not None:
        rows = rows.unionByName(change(inserts, 1).withColumn("o", F.lit(1)))
        left = left.unionByName(inserts.select("doc_id", "digest"))
    if deletes is not None:
        gone = deletes.select("doc_id", "digest")
        known = gone.join(left.distinct(), ["doc_id", "digest"], "left_semi")
        rows = rows.unionByName(change(known, -1).withColumn("o", F.lit(2)))
        left = left.join(gone.distinct(), ["doc_id", "digest"], "left_anti")
    dealt = rows.repartition(shards or _shards(index), "digest").sortWithinPartitions("o").drop("o")
    made = materialize(dealt.mapInArrow(lean(_index_shard), _CLASSES + ", open boolean"), "index")
    next_ = left.join(made.where("open").select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("_next"))
    return made.join(next_, "digest", "left").select("digest", F.coalesce("keep_id", "_next").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, normalised: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays. Rows repeated with one doc_id are
    one document and get equal results; a row without doc_id never outranks one with (a class of such rows has a null
    keep_id, and all of it stays). An empty table gives an empty result. Texts of any length are one digest each.
    """
    keyed = materialize(digests(docs, normalised), "digests")
    classes = build_index(keyed)
    joined = keyed.join(classes, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, one per text, with all their columns; rows repeated whole stay once.

    doc_id identifies a text; rows without doc_id whose text another row has go, too.
    """
    found = materialize(exact_duplicates(docs), "classes")
    gone = materialize(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "gone")
    stay = by_ids(docs, gone, "left_anti")
    twice = materialize(found.where("kept and group_size > 1").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "twice")
    nameless = found.where("doc_id is null").select("text_sha256").distinct().limit(1)
    if twice.isEmpty() and nameless.isEmpty():
        return stay
    named = stay.where("doc_id is not null")
    once = by_ids(named, twice).dropDuplicates(["doc_id", "text"])
    sha = fresh(docs, "sha")
    lost = stay.where("doc_id is null").withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    held = found.where("doc_id is not null").select(F.col("text_sha256").alias(sha)).distinct()
    lost = lost.join(held, sha, "left_anti").dropDuplicates([sha]).drop(sha)
    return by_ids(named, twice, "left_anti").unionByName(once).unionByName(lost.select(*docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_documents(spark, sf_dir))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
