"""Cutting lineage through the shared folder of the cluster.

Intermediate tables that are read more than once (a time-ordered layout, a
feature table, one level of itemsets) are written as parquet into
``spark.checkpoint.dir``. Unlike a cached table they survive the loss of an
executor, and unlike ``DataFrame.checkpoint`` they keep column pruning, filter
pushdown and size statistics for the jobs that follow. Only where the partitions
themselves must stay fixed is ``checkpoint`` used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a fresh local one only when none
    is named and the session runs on this machine alone."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronolode-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the folder, which can be removed
    as a whole once the application has ended."""
    mine = f"{checkpoint_folder(spark).rstrip('/')}/chronolode-{spark.sparkContext.applicationId}"
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written copy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def fixed_partitions(df: DataFrame, parts: int, by: str) -> DataFrame:
    """Checkpoint ``df`` in exactly ``parts`` partitions by a hash of ``by``, each
    sorted by it. Unlike a file scan, whose partitions depend on the number of
    cores, every reader gets the same rows in the same partition and order."""
    return checkpointed(df.repartition(parts, by).sortWithinPartitions(by))


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the partitions and order that it has."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()
