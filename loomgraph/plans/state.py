"""Cutting lineage between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) is a folder of our own made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR.append(tempfile.mkdtemp(prefix="loomgraph-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` that keeps partitioning and order, so that joins on the same key afterwards need no exchange.

    An adaptive plan's partitioning is unknown to the plans that read its checkpoint (they would deal state and edges
    anew every round), so this one is planned as it stands.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def cut_counting(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """``cut_dealt`` and the number of rows for which ``which`` holds, counted by the tasks that write: no job of its own.

    Tasks that run again may count twice, so only whether there are any is exact.
    """
    seen = Observation()
    done = cut_dealt(df.observe(seen, F.count_if(which).alias("n")))
    counted = seen.get.get("n")
    return done, done.where(which).count() if counted is None else counted


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans, which Spark keeps until the driver collects garbage: the phases of a
    long job then don't add up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return the reread table.

    Cuts the lineage: a lost executor afterwards costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
