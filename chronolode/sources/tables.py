"""Parquet inputs, result sinks and small result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.sources.observations import nan_to_null


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table, with NULL in place of NaN."""
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", null_value: str = "NA") -> None:
    """Write a result without an index column. Nested columns become JSON text
    when the format is CSV. Every partition writes its own file."""
    if fmt != "csv":
        df.write.format(fmt).save(path)
        return
    flat = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    df.select(*flat).write.option("header", True).option("nullValue", null_value).csv(path)


def to_table(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of a few driver-side records (best parameters, coefficients
    per fold). Never used for itemsets, rules or predictions."""
    return spark.createDataFrame(list(rows), schema)
