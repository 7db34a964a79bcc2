"""Tables behind a data profile: missingness, distributions, correlation and
seasonality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.calendar import period_start
from chronolode.functions.encoding import band
from chronolode.functions.quantiles import MAX_ROWS, grouped_quantiles, quantile
from chronolode.operators.series import series
from chronolode.sources.scratch import materialise


def missing_by_period(df: DataFrame, col: str, ts: str, unit: str = "month") -> DataFrame:
    """Percent of rows without a value per calendar period, on unfilled data."""
    period = period_start(F.col(ts), unit)
    missing = F.avg(F.col(col).isNull().cast("int")) * 100
    return df.groupBy(period.alias("period")).agg(missing.alias("missing_pct")).orderBy("period")


def histogram(df: DataFrame, col: str, bins: int = 120) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin holds the maximum and
    empty bins are listed. One pass for the range, one for the counts."""
    spark = df.sparkSession
    span = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if span["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = span["lo"], span["hi"]
    if lo == hi:  # a constant column still gets a range of width one
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * bins)
    counted = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    width = (hi - lo) / bins
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        frame.join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def band_counts(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rows per right-closed band, in band order and with empty bands."""
    counted = df.groupBy(band(F.col(col), edges, labels).alias("band")).agg(F.count("*").alias("n"))
    rows = [(i, float(lo), float(hi), label) for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels))]
    frame = df.sparkSession.createDataFrame(rows, "band_no int, lo double, hi double, band string")
    return (
        frame.join(counted, "band", "left")
        .select("band_no", "band", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("band_no")
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of columns as ``(a, b, r)``. All
    pairs share one aggregate; a pair uses the rows where both have a value."""
    pairs = [(a, a) for a in cols] + list(combinations(cols, 2))
    one = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")))
    return one.select(F.inline(F.array(*cells)))


def box_stats(
    df: DataFrame, key: str, col: str, domain: Sequence, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Quartiles and whiskers per key of ``domain``, keys without rows included.
    A whisker is the most extreme value within 1.5 quartile ranges of the box,
    and never lies inside the box."""
    spark = df.sparkSession
    kept = df.where(F.col(key).isin(*domain) & F.col(col).isNotNull()).select(key, F.col(col).cast("double").alias("__v"))
    quartiles = grouped_quantiles(kept, key, "__v", [0.25, 0.5, 0.75], max_rows)
    # written, because it is read twice and costs a pass over the table
    box = materialise(
        quartiles.select(
            key,
            "n",
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
        ),
        "quartiles",
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # the box table has one row per key of the given domain
    ends = (
        kept.join(F.broadcast(box), key)
        .groupBy(key)
        .agg(
            F.min(F.when(F.col("__v") >= F.col("q1") - reach, F.col("__v"))).alias("lo"),
            F.max(F.when(F.col("__v") <= F.col("q3") + reach, F.col("__v"))).alias("hi"),
        )
    )
    frame = spark.createDataFrame([(k,) for k in domain], df.select(key).schema)
    return (
        frame.join(box, key, "left")
        .join(ends, key, "left")
        .select(
            key,
            F.coalesce("n", F.lit(0)).alias("n"),
            "q1",
            "median",
            "q3",
            F.least("lo", "q1").alias("whisker_lo"),
            F.greatest("hi", "q3").alias("whisker_hi"),
        )
        .orderBy(key)
    )


def mean_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Mean per key, highest first; rows without a key are left out."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(col).alias("mean"))
        .orderBy(F.desc("mean"), key)
    )


def describe_frame(df: DataFrame, ts: str, features: Sequence[str] | None = None) -> DataFrame:
    """Row count, feature names and time range, as one row."""
    names = [c for c in df.columns if c != ts] if features is None else list(features)
    return df.agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    ).withColumn("features", F.lit(", ".join(names)))


@dataclass(frozen=True)
class ProfileSpec:
    """Columns and bands of a profile."""

    ts: str
    label: str
    numeric: tuple[str, ...]
    category: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]
    bins: int = 120
    display_quantile: float = 0.995


def profile(raw: DataFrame, filled: DataFrame, spec: ProfileSpec) -> Mapping[str, DataFrame]:
    """All profile tables: missingness from the unfilled table, the rest from the
    gap-filled one, which must still hold its category column. Each table reads
    its input anew, so pass ``filled`` as a written table."""
    by_month = filled.withColumn("month", F.month(spec.ts))
    spark = filled.sparkSession
    cut = quantile(filled, spec.label, spec.display_quantile)
    return {
        "missing": missing_by_period(raw, spec.label, spec.ts),
        "series": series(filled, spec.ts, spec.label),
        "histogram": histogram(filled, spec.label, spec.bins),
        "bands": band_counts(filled, spec.label, spec.edges, spec.labels),
        "display_cut": spark.createDataFrame([(spec.display_quantile, cut)], "p double, value double"),
        "correlation": correlation_matrix(filled, [spec.label, *spec.numeric]),
        "by_month": box_stats(by_month, "month", spec.label, list(range(1, 13))),
        "by_category": mean_by(filled, spec.category, spec.label),
    }
