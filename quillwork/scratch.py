"""Reliable intermediate tables.

Multi-stage jobs that must see one fixed copy of their rows (ranks, graph rounds) write it to the
shared folder named by ``spark.checkpoint.dir``. A lost executor then only costs a re-read.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A session of one process (master ``local``), as in tests, may leave it unset and gets a temporary one. On a
    cluster that is an error: a folder of one machine would hold a part of the rows on every executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillwork-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str = "stage") -> str:
    return f"{scratch_dir(spark)}/quillwork/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return the written table; cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle into the session's full number of partitions.

    For work that is heavy on the processor but light in bytes, which adaptive execution would
    otherwise merge into very few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def balance(df: DataFrame) -> DataFrame:
    """Spread a small input over all slots; leave a large one as its splits have it.

    The size is the optimizer's estimate. Below one default split per slot a shuffle costs next to nothing
    and keeps heavy expressions from running in one task; above it the scan is parallel anyway.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = 128 * 1024 * 1024
    return df.repartition(slots) if size < slots * split else df
