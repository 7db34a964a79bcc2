"""Regression scores and the tables made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("mae", "rmse", "r2")


def regression_scores(
    df: DataFrame, label: str = "label", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and R2 in one pass. R2 measures against the mean of the scored
    labels and is null when they are all equal."""
    error = F.col(label) - F.col(pred)
    parts = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("__mse"),
        F.var_pop(label).alias("__var"),
    )
    r2 = F.when(F.col("__var") > 0, 1 - F.col("__mse") / F.col("__var"))
    return parts.select(*by, "mae", F.sqrt("__mse").alias("rmse"), r2.alias("r2"))


def mean_scores(fold_scores: DataFrame, by: Sequence[str] = ("algorithm",)) -> DataFrame:
    """Average of the fold scores of each model."""
    return fold_scores.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS])


def gain_vs_baseline(
    summary: DataFrame, baseline: str, metric: str = "r2", by: Sequence[str] = (), out: str = "gain"
) -> DataFrame:
    """Difference of each model's score to the baseline's, within ``by``. The
    summary has one row per model, so its windows are small."""
    score = F.max(F.when(F.col("algorithm") == baseline, F.col(metric)))
    if by:
        return summary.withColumn(out, F.col(metric) - score.over(Window.partitionBy(*by)))
    return summary.withColumn(out, F.col(metric) - summary.agg(score.alias("s")).scalar())


def unpivot_scores(df: DataFrame, ids: Sequence[str] = ("algorithm", "fold")) -> DataFrame:
    """One row per id and metric: ``(ids..., metric, value)``."""
    return df.unpivot(list(ids), list(METRICS), "metric", "value")


def fold_lists_to_rows(df: DataFrame) -> DataFrame:
    """Score lists per model, ``(algorithm, mae[], rmse[], r2[])``, to one row per
    fold with folds counted from 1."""
    zipped = F.posexplode(F.arrays_zip(*METRICS))
    return df.select("algorithm", zipped.alias("at", "s")).select(
        "algorithm", (F.col("at") + 1).alias("fold"), *[F.col(f"s.{m}").alias(m) for m in METRICS]
    )


def best_model(scores: DataFrame) -> DataFrame:
    """The row with the highest R2; equal scores by name."""
    return scores.orderBy(F.desc_nulls_last("r2"), "algorithm").limit(1)


def best_of_tuned(untuned: DataFrame, tuned: DataFrame) -> DataFrame:
    """The best row of both tables; a tuned model must be strictly better."""
    both = best_model(untuned).withColumn("__tuned", F.lit(0)).unionByName(
        best_model(tuned).withColumn("__tuned", F.lit(1))
    )
    return both.orderBy(F.desc_nulls_last("r2"), "__tuned").limit(1).drop("__tuned")


def compare_scores(untuned: DataFrame, tuned: DataFrame, suffix: str = " [Tuned]") -> DataFrame:
    """Untuned and tuned scores in one table, best R2 first."""
    marked = tuned.withColumn("algorithm", F.concat("algorithm", F.lit(suffix)))
    return untuned.unionByName(marked).orderBy(F.desc_nulls_last("r2"), "algorithm")


def summarise_seeds(per_seed: DataFrame) -> DataFrame:
    """Mean, population standard deviation, minimum, maximum and range of each
    metric over the seeds of a model, best mean R2 first."""
    aggs = []
    for m in ("r2", "rmse", "mae"):
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
            (F.max(m) - F.min(m)).alias(f"{m}_range"),
        ]
    return (
        per_seed.groupBy("algorithm")
        .agg(*aggs, F.countDistinct("seed").alias("n_seeds"))
        .orderBy(F.desc_nulls_last("r2_mean"), "algorithm")
    )


def scores_long(df: DataFrame, ids: Sequence[str] = ("algorithm",), sort_metric: str = "r2") -> DataFrame:
    """Chart-ready scores: one row per id and metric with a short label and the
    rank of the model by ``sort_metric`` within the other ids."""
    others = [c for c in ids if c != "algorithm"]
    ranked = df.withColumn(
        "place",
        F.row_number().over(Window.partitionBy(*others).orderBy(F.desc_nulls_last(sort_metric), "algorithm")),
    )
    label = F.regexp_replace("algorithm", " Regress(or|ion)", "")
    return ranked.withColumn("label", label).unpivot([*ids, "label", "place"], list(METRICS), "metric", "value")
