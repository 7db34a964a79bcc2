"""What the operators on documents share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.sources import scratch

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A table is sent to every executor only if it was counted and is no larger.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs run inside hand Python workers this many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, at_once: int = 1024) -> DataFrame:
    """``df`` written once to the shared scratch folder and read from there. Python
    workers get ``at_once`` rows at a time."""
    spark, path = df.sparkSession, scratch.scratch_path(df.sparkSession, name)
    with small_batches(spark, at_once):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def written(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df`` written once, marked for broadcast if its counted rows are few
    (each row must be small); beyond that joins shuffle it. The row count."""
    df = materialise(df, name)
    rows = df.count()
    return (F.broadcast(df) if rows <= most else df), rows


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``df`` in one column ``row``, next to ``extra``, so that no
    name of the caller's can clash with a working column."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")
