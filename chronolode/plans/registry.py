"""Name -> query and, where SQL can state the result, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def keep(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return keep


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round float results, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, places) for c in cols})


# Means of a few short decimals often lie exactly between two rounded values, and
# sines next to zero on either side of it, where engines round differently. A
# shift far below the last place decides.
TIE_SHIFT = "2e-10"


def steady(df: DataFrame, *cols: str) -> DataFrame:
    """``rounded`` to six places for values that may lie on such a tie."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(float(TIE_SHIFT)), 6) for c in cols})


def steady_sql(value: str) -> str:
    return f"round({value} + {TIE_SHIFT}, 6)"
