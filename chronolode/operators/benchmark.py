"""Expanding-window and holdout benchmarks, horizons and seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from typing import TypeVar

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.operators.features import FeatureSpec, horizon_features, with_levels
from chronolode.operators.models import ModelSpec, TrainingTable, assembled, fit, lay_out
from chronolode.operators.ordering import TimeOrder, fold_starts, holdout_start, with_position
from chronolode.operators.ridge import ridge_fold_predictions
from chronolode.operators.scoring import gain_vs_baseline, mean_scores, regression_scores
from chronolode.sources.scratch import materialise

A = TypeVar("A")
B = TypeVar("B")


def at_once(job: Callable[[A], B], inputs: Sequence[A], parallelism: int = 4) -> list[B]:
    """Run independent Spark jobs from a few driver threads; results keep the
    order of the inputs."""
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(inputs) or 1))) as pool:
        return list(pool.map(job, inputs))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fold_predictions(
    table: TrainingTable, models: Sequence[ModelSpec], k: int = 5, parallelism: int = 4
) -> DataFrame:
    """Every model's predictions on every validation range, fitted on all earlier
    rows: ``(algorithm, fold, label, prediction)``. Ridge models share one pass."""
    starts, size = fold_starts(table.rows, k)
    parts = []
    linear = [m for m in models if m.family == "ridge"]
    if linear:
        names = table.df.sparkSession.createDataFrame(
            [(m.name, float(m.params["alpha"])) for m in linear], "algorithm string, alpha double"
        )
        alphas = sorted({float(m.params["alpha"]) for m in linear})
        predicted = ridge_fold_predictions(table, alphas, k)
        parts.append(predicted.join(F.broadcast(names), "alpha").select("algorithm", "fold", "label", "prediction"))

    tasks = [(m, f) for m in models if m.family != "ridge" for f in range(k)]
    whole = assembled(table) if tasks else table

    def one(task: tuple[ModelSpec, int]) -> DataFrame:
        spec, f = task
        model = fit(spec, whole.first(starts[f]))
        scored = whole.score(model, starts[f], starts[f] + size)
        return scored.select(
            F.lit(spec.name).alias("algorithm"),
            F.lit(f + 1).alias("fold"),
            F.col(table.label).alias("label"),
            "prediction",
        )

    parts += at_once(one, tasks, parallelism)
    return _union(parts)


def cv_fold_scores(
    table: TrainingTable, models: Sequence[ModelSpec], k: int = 5, parallelism: int = 4
) -> DataFrame:
    """``(algorithm, fold, mae, rmse, r2)`` of every model on the same folds."""
    return regression_scores(fold_predictions(table, models, k, parallelism), by=["algorithm", "fold"])


def cv_benchmark(
    table: TrainingTable, models: Sequence[ModelSpec], k: int = 5, baseline: str = "ridge", parallelism: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Mean fold scores with the gain over the baseline, best first, and the fold
    scores themselves. The fold scores are written, so fits are not repeated."""
    folds = materialise(cv_fold_scores(table, models, k, parallelism), "fold-scores")
    summary = gain_vs_baseline(mean_scores(folds), baseline)
    return summary.orderBy(F.desc_nulls_last("r2"), "algorithm"), folds


def holdout_predictions(
    table: TrainingTable, models: Sequence[ModelSpec], frac: float = 0.2, parallelism: int = 4
) -> tuple[DataFrame, dict[str, Model]]:
    """Fit every model on the first rows and predict the rest:
    ``(algorithm, pos, label, prediction)`` and the fitted models."""
    cut = holdout_start(table.rows, frac)
    whole = assembled(table) if len(models) > 1 else table
    train = whole.first(cut)
    fitted = dict(zip([m.name for m in models], at_once(lambda m: fit(m, train), models, parallelism)))
    parts = [
        whole.score(model, cut, whole.rows).select(
            F.lit(name).alias("algorithm"), table.pos, F.col(table.label).alias("label"), "prediction"
        )
        for name, model in fitted.items()
    ]
    return _union(parts), fitted


def holdout_benchmark(
    table: TrainingTable, models: Sequence[ModelSpec], frac: float = 0.2, parallelism: int = 4
) -> tuple[DataFrame, dict[str, Model]]:
    """Holdout scores, best first, and the fitted models."""
    predicted, fitted = holdout_predictions(table, models, frac, parallelism)
    scores = regression_scores(predicted, by=["algorithm"])
    return scores.orderBy(F.desc_nulls_last("r2"), "algorithm"), fitted


def seed_robustness(
    table: TrainingTable,
    models: Sequence[ModelSpec],
    seeds: Sequence[int] = (0, 1, 2, 3, 4),
    frac: float = 0.2,
    forest_trees: int | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Holdout scores of every model refitted per seed on one fixed split:
    ``(algorithm, seed, mae, rmse, r2)``. Ridge uses no seed; it is fitted once
    and its scores are repeated."""
    cut = holdout_start(table.rows, frac)
    whole = assembled(table)
    train = whole.first(cut)

    def one(task: tuple[ModelSpec, int | None]) -> DataFrame:
        spec, seed = task
        if spec.family == "forest" and forest_trees is not None:
            spec = spec.with_params(trees=forest_trees)
        model = fit(spec if seed is None else replace(spec, seed=seed), train)
        wanted = F.array(*[F.lit(s) for s in seeds]) if seed is None else F.array(F.lit(seed))
        return whole.score(model, cut, whole.rows).select(
            F.lit(spec.name).alias("algorithm"),
            F.explode(wanted).alias("seed"),
            F.col(table.label).alias("label"),
            "prediction",
        )

    tasks: list[tuple[ModelSpec, int | None]] = [(m, None) for m in models if m.family == "ridge"]
    tasks += [(m, s) for m in models if m.family != "ridge" for s in seeds]
    return regression_scores(_union(at_once(one, tasks, parallelism)), by=["algorithm", "seed"])


def horizon_tables(
    df: DataFrame, spec: FeatureSpec, order: TimeOrder, horizons: Sequence[int]
) -> dict[int, TrainingTable]:
    """One training table per horizon. Features are built once and written by
    horizon; positions are numbered within each."""
    spec = with_levels(df, spec)
    stacked = horizon_features(df, spec, order, horizons)
    timeline = TimeOrder(order.ts, ties=(*order.ties, *order.keys), keys=("horizon",))
    features = materialise(stacked, "horizon-features", ("horizon",))
    placed = with_position(features, timeline)
    sizes = {r["horizon"]: r["n"] for r in features.groupBy("horizon").agg(F.count("*").alias("n")).collect()}
    return {
        h: lay_out(placed.where(F.col("horizon") == h), sizes[h], spec.columns)
        for h in horizons
    }


def horizon_benchmark(
    df: DataFrame,
    spec: FeatureSpec,
    order: TimeOrder,
    horizons: Sequence[int],
    models: Sequence[ModelSpec],
    k: int = 5,
    baseline: str = "ridge",
    parallelism: int = 4,
) -> DataFrame:
    """Mean fold scores per horizon and model, with the gain over the baseline of
    the same horizon."""
    tables = horizon_tables(df, spec, order, horizons)
    parts = [
        cv_fold_scores(t, models, k, parallelism).withColumn("horizon", F.lit(h)) for h, t in tables.items()
    ]
    folds = materialise(_union(parts), "horizon-scores")
    summary = mean_scores(folds, by=["horizon", "algorithm"])
    return gain_vs_baseline(summary, baseline, by=["horizon"]).orderBy("horizon", F.desc_nulls_last("r2"), "algorithm")
