"""From raw documents to packed training sequences: the stages, and ``run`` over the documents table.

Every stage is an operator of ``loomgraph.llm`` on all that the stage before it kept. The result of each is written as
Parquet in the shared folder and reread, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import tokenizer_path
from loomgraph.llm.common import materialize, read_documents
from loomgraph.llm.exact_dedup import drop_exact_duplicates
from loomgraph.llm.near_dedup import drop_near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.substring_dedup import drop_repeats
from loomgraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 over five-word shingles the one with the least doc_id stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 100-byte string that also starts earlier go; every document stays."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and offset."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Trained scores, MinHash candidates, tokenizers: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
