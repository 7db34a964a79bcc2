"""Paired tests between models over their folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.distributions import (
    EXACT_PAIRS,
    normal_two_sided,
    signed_rank_exact,
    signed_rank_exact_tied,
    student_t_two_sided,
)
from chronolode.operators.ordering import MAX_SERIES_ROWS, TimeOrder, with_position
from chronolode.operators.scoring import METRICS, unpivot_scores


def pivot_scores(df: DataFrame, metric: str, names: Sequence[str]) -> DataFrame:
    """One row per fold, one column per model. Two scores of one model in one
    fold are an error."""
    cell = F.when(F.count(metric) <= 1, F.max(metric)).otherwise(
        F.raise_error(F.lit("more than one score per model and fold")).cast("double")
    )
    return df.groupBy("fold").pivot("algorithm", list(names)).agg(cell)


def score_pairs(names: Sequence[str], baseline: str | None = None) -> list[tuple[str, str]]:
    """All pairs of models by name, or the baseline against each other one."""
    names = sorted(names)
    if baseline is None:
        return list(combinations(names, 2))
    if baseline not in names:
        raise ValueError(f"baseline {baseline!r} not found in {names}")
    return [(baseline, other) for other in names if other != baseline]


def paired_scores(long: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Scores of both models of each pair side by side:
    ``(model_a, model_b, metric, fold, a, b)``."""
    listed = long.sparkSession.createDataFrame(list(pairs), "model_a string, model_b string")
    first = long.select(F.col("algorithm").alias("model_a"), "metric", "fold", F.col("value").alias("a"))
    second = long.select(F.col("algorithm").alias("model_b"), "metric", "fold", F.col("value").alias("b"))
    return listed.join(first, "model_a").join(second, ["model_b", "metric", "fold"])


def paired_t_test(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Paired t-test per group: ``(by..., n, mean_diff, t_stat, t_p)``. When all
    differences are zero both statistic and p are null; when they are equal but
    not zero, p is 0."""
    d = F.col(a) - F.col(b)
    grouped = df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("__sd")
    )
    error = F.col("__sd") / F.sqrt(F.col("n").cast("double"))
    t = F.when(F.col("__sd") > 0, F.col("mean_diff") / error).when(
        (F.col("__sd") == 0) & (F.col("mean_diff") != 0),
        F.signum("mean_diff") * F.lit(float("inf")),
    )
    return (
        grouped.withColumn("t_stat", t)
        .withColumn("t_p", student_t_two_sided(F.col("t_stat"), F.col("n") - 1))
        .drop("__sd")
    )


def wilcoxon_signed_rank(
    df: DataFrame,
    a: str,
    b: str,
    by: Sequence[str],
    pair_id: str = "fold",
    max_rows: int = MAX_SERIES_ROWS,
    method: str = "auto",
    exact_pairs: int = EXACT_PAIRS,
) -> DataFrame:
    """Two-sided signed rank test per group: ``(by..., n_nonzero, w_stat, w_p)``.

    Zero differences are dropped and equal sizes share their mean rank. By
    ``method`` "auto" p is exact without ties and with up to 50 pairs, otherwise
    normal with tie correction; "exact" counts all sign patterns with ties too, in groups of
    up to ``exact_pairs`` differences (its work grows with the third power of them), and gives
    null beyond; "normal" uses the approximation always. Groups without any difference give
    null. Ranks are positions by size, so that a long group is not ranked in one task."""
    diffs = df.select(*by, pair_id, (F.col(a) - F.col(b)).alias("__d"))
    sized = diffs.where(F.col("__d").isNotNull() & (F.col("__d") != 0)).withColumn("__size", F.abs("__d"))
    order = TimeOrder("__size", ties=(pair_id,), keys=tuple(by))
    placed = with_position(sized, order, "__pos", max_rows)
    ties = placed.groupBy(*by, "__size").agg(
        F.count("*").alias("c"),
        F.sum((F.col("__d") > 0).cast("long")).alias("up"),
        (F.avg("__pos") + 1).alias("rank"),
    )
    sums = ties.groupBy(*by).agg(
        F.sum("c").alias("n_nonzero"),
        F.sum(F.col("rank") * F.col("up")).alias("__plus"),
        F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("__minus"),
        F.max("c").alias("__most"),
        F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("__tied"),
    )
    n = F.col("n_nonzero").cast("double")
    w = F.least("__plus", "__minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__tied") / 48)
    countable = (F.col("n_nonzero") <= EXACT_PAIRS) & (F.col("__most") == 1)
    exact = F.when(countable, signed_rank_exact(w, F.least(F.col("n_nonzero"), F.lit(EXACT_PAIRS))))
    if method == "exact":  # the ranks of small groups, each as often as it occurs
        few = sums.where(F.col("n_nonzero") <= exact_pairs).select(*[F.col(c).alias(f"__{c}") for c in by])
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
        small = ties.join(few, same, "left_semi")
        repeated = F.array_repeat("rank", F.col("c").cast("int"))
        ranks = small.groupBy(*by).agg(F.flatten(F.collect_list(repeated)).alias("__ranks"))
        joined = sums.alias("s").join(ranks.select(*[F.col(c).alias(f"__{c}") for c in by], "__ranks"), same, "left")
        sums = joined.select("s.*", "__ranks")
        exact = F.when(F.col("__ranks").isNotNull(), signed_rank_exact_tied(w, F.col("__ranks")))
    normal = normal_two_sided((w - n * (n + 1) / 4) / spread)
    p = {"auto": F.when(countable, exact).otherwise(normal), "exact": exact, "normal": normal}[method]
    tested = sums.select(*by, "n_nonzero", w.alias("w_stat"), p.alias("w_p"))
    return df.select(*by).distinct().join(tested, list(by), "left")


def paired_tests(
    fold_scores: DataFrame,
    names: Sequence[str],
    baseline: str | None = None,
    metrics: Sequence[str] = METRICS,
    alpha: float = 0.05,
) -> DataFrame:
    """Both tests for every pair and metric. ``higher_mean`` names the model with
    the larger number, which for an error metric is the worse one; a tie names
    the second. A p-value that is not defined gives a null flag."""
    long = unpivot_scores(fold_scores).where(F.col("metric").isin(*metrics))
    both = paired_scores(long, score_pairs(names, baseline))
    by = ["model_a", "model_b", "metric"]
    t = paired_t_test(both, "a", "b", by)
    w = wilcoxon_signed_rank(both, "a", "b", by)
    return t.join(w, by).select(
        *by,
        "mean_diff",
        F.when(F.col("mean_diff") > 0, F.col("model_a")).otherwise(F.col("model_b")).alias("higher_mean"),
        "t_p",
        "w_p",
        (F.col("t_p") < alpha).alias("significant_t"),
        (F.col("w_p") < alpha).alias("significant_w"),
    )


def significance_vs_baseline(
    fold_scores: DataFrame, names: Sequence[str], baseline: str, metrics: Sequence[str] = ("r2", "rmse", "mae")
) -> DataFrame:
    """``paired_tests`` of the baseline against every other model, all metrics in
    one job."""
    return paired_tests(fold_scores, names, baseline, metrics)
