"""Ridge regression for many folds and penalties from one pass.

The normal equations need only sums of products. Those sums are taken once per
validation range; expanding folds are running totals of them, and every penalty
solves the same small system. A benchmark over k folds and a penalties is one
aggregate job and one scoring job instead of k * a fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.operators.models import TrainingTable
from chronolode.operators.ordering import fold_of

# Above about a hundred columns Spark stops compiling an aggregate.
MAX_SUMS = 90

_COEF_SCHEMA = "fold int, alpha double, intercept double, coefs array<double>"


def sums_of_products(
    table: TrainingTable, segment: Column, center: Sequence[float], max_sums: int = MAX_SUMS
) -> dict[int, np.ndarray]:
    """Per value of the integer expression ``segment``: the matrix of sums of
    products over ``(1, features, label)``, each column taken around ``center``.
    Few columns are summed as built-in aggregates; more would leave generated
    code, so then every task multiplies its rows as matrices and emits one
    matrix per segment."""
    names = [*table.features, table.label]
    p = len(names) + 1
    moved = [(F.col(c).cast("double") - F.lit(m)).alias(f"c{i}") for i, (c, m) in enumerate(zip(names, center), 1)]
    rows = table.df.select(segment.alias("segment"), F.lit(1.0).alias("c0"), *moved)
    i, j = np.triu_indices(p)
    if len(i) <= max_sums:
        sums = rows.groupBy("segment").agg(
            *[F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"s{k}") for k, (a, b) in enumerate(zip(i, j))]
        )
        cells = [(r["segment"], a, b, r[f"s{k}"]) for r in sums.collect() for k, (a, b) in enumerate(zip(i, j))]
    else:

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                at = batch.column(0).to_numpy()
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
                for s in np.unique(at).tolist():
                    part = x[at == s]
                    totals[s] = totals.get(s, 0) + part.T @ part
            for s, m in totals.items():
                cells = [np.full(len(i), s, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["segment", "i", "j", "s"])

        parts = rows.mapInArrow(partial, "segment int, i int, j int, s double")
        cells = [tuple(r) for r in parts.groupBy("segment", "i", "j").agg(F.sum("s")).collect()]
    found: dict[int, np.ndarray] = {}
    for s, a, b, value in cells:
        m = found.setdefault(s, np.zeros((p, p)))
        m[a, b] = m[b, a] = value
    return found


def column_means(table: TrainingTable) -> list[float]:
    names = [*table.features, table.label]
    row = table.df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return [float(v) for v in row]


def solve(sums: np.ndarray, center: Sequence[float], alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from one matrix of sums of products."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    spread = sums[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = spread[:-1, :-1], spread[:-1, -1]
    system = xx + alpha * np.eye(len(xx))
    coefs = np.linalg.solve(system, xy) if alpha > 0 else np.linalg.lstsq(system, xy, rcond=None)[0]
    true_mean = mean + np.asarray(center)
    return float(true_mean[-1] - coefs @ true_mean[:-1]), coefs


def ridge_coefficients(table: TrainingTable, alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """Coefficients on the whole table per penalty, as ``(alpha, term, value)``."""
    center = column_means(table)
    sums = sums_of_products(table, F.lit(0), center)[0]
    rows = []
    for alpha in alphas:
        intercept, coefs = solve(sums, center, alpha)
        rows.append((float(alpha), "intercept", intercept))
        rows += [(float(alpha), f, float(b)) for f, b in zip(table.features, coefs)]
    return table.df.sparkSession.createDataFrame(rows, "alpha double, term string, value double")


def ridge_fold_predictions(table: TrainingTable, alphas: Sequence[float], k: int) -> DataFrame:
    """Predictions for every validation row under every penalty, each from the
    rows before its fold: ``(fold, alpha, pos, label, prediction)``."""
    spark = table.df.sparkSession
    center = column_means(table)
    fold = fold_of(F.col(table.pos), table.rows, k)
    sums = sums_of_products(table, fold, center)
    rows = []
    running = sums[0]
    for f in range(1, k + 1):
        for alpha in alphas:
            intercept, coefs = solve(running, center, alpha)
            rows.append((f, float(alpha), intercept, [float(b) for b in coefs]))
        running = running + sums[f]
    coef_table = spark.createDataFrame(rows, _COEF_SCHEMA)  # k * len(alphas) rows
    prediction = F.col("intercept")
    for i, c in enumerate(table.features):
        prediction = prediction + F.col("coefs")[i] * F.col(c)
    return (
        table.df.withColumn("fold", fold)
        .where(F.col("fold") > 0)
        .join(F.broadcast(coef_table), "fold")
        .select("fold", "alpha", table.pos, F.col(table.label).alias("label"), prediction.alias("prediction"))
    )
