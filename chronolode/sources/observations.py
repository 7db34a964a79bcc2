"""Delimited scans of hourly observations and their time axis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that data frame readers commonly take for missing.
USUAL_NULLS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float column, so that later operators only
    ever meet one kind of missing value."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c)
            if c in floats
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_observations(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    null_values: Sequence[str] = USUAL_NULLS,
) -> DataFrame:
    """Scan a CSV with a header; every token of ``null_values`` and every empty
    field is missing. Columns are taken by place, so ``schema`` may rename them
    (``pm2.5`` to ``pm25``). A field that does not parse is an error."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if len(null_values) <= 1:
        reader = reader.option("nullValue", null_values[0] if null_values else "")
        return nan_to_null(reader.schema(schema).csv(path))
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = reader.schema(text).csv(path)
    typed = [
        F.when(~F.col(f"`{f.name}`").isin(*null_values), F.col(f"`{f.name}`"))
        .cast(f.dataType)
        .alias(f.name)
        for f in schema
    ]
    return nan_to_null(raw.select(*typed))


def with_timestamp(df: DataFrame, parts: Mapping[str, str], out: str = "ts") -> DataFrame:
    """Add a zone-free timestamp from integer parts, e.g.
    ``{"year": "year", "month": "month", "day": "day", "hour": "hour"}``."""

    def part(name: str, default: int) -> Column:
        return F.col(parts[name]) if name in parts else F.lit(default)

    return df.withColumn(
        out,
        F.make_timestamp_ntz(
            part("year", 1970),
            part("month", 1),
            part("day", 1),
            part("hour", 0),
            part("minute", 0),
            part("second", 0),
        ),
    )


def with_month_start(df: DataFrame, year: str, month: str, out: str = "month_start") -> DataFrame:
    """Add the first instant of the month named by two integer columns."""
    return with_timestamp(df, {"year": year, "month": month}, out)
