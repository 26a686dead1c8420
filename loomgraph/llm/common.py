"""Helpers shared by the training-data operators: shared tables and document columns."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import materialize, release, shared_dir  # noqa: F401  used by the operators from here
from ..plans.state import shuffle_partitions as partitions  # noqa: F401


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow`` in workers that outlive their task: what a task has freed goes back to the system when
    it ends, so an idle worker of an earlier step doesn't hold the memory of the next."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return task


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text as empty); other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


#: Ids up to this number (some 16 MB) are broadcast instead of dealing whole documents by id.
BROADCAST_IDS = 2_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``left_anti``: isn't) in the materialised table ``ids`` (id).

    The ids are counted first: a bounded number is broadcast and the documents stay where they are; more are joined by
    dealing out both sides.
    """
    name = fresh(docs, "wanted_id")
    ids = ids.select(F.col("id").alias(name))
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").cast("long") == F.col(name), how)
