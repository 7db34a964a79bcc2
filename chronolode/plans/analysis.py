"""The whole analysis of one table of observations, from profile to rules.

Work that several results need is done once: one feature table per horizon, one
mining pass for common and rare conditions, and fold scores at horizon zero that
serve the benchmark, the tests and the horizon comparison.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.encoding import ItemRule, discretize, to_baskets
from chronolode.operators.attribution import attribution_ranking, sample_rows, tree_attributions
from chronolode.operators.benchmark import (
    cv_benchmark,
    holdout_benchmark,
    horizon_tables,
    seed_robustness,
)
from chronolode.operators.features import FeatureSpec, with_levels
from chronolode.operators.itemsets import common_and_rare_rules
from chronolode.operators.models import ModelSpec, TrainingTable, default_models, fit, score
from chronolode.operators.ordering import TimeOrder, head_by_time, holdout_start, prepare_series
from chronolode.operators.profile import ProfileSpec, describe_frame, profile
from chronolode.operators.scoring import best_of_tuned, compare_scores, regression_scores, summarise_seeds
from chronolode.operators.series import complete_rows, interpolate_linear
from chronolode.operators.significance import significance_vs_baseline
from chronolode.operators.tuning import Search, default_searches, tune_all
from chronolode.sources.scratch import materialise
from chronolode.sources.tables import write_table


@dataclass(frozen=True)
class Analysis:
    """What to analyse. Thresholds default to the published ones."""

    order: TimeOrder
    features: FeatureSpec
    profile: ProfileSpec
    items: Sequence[ItemRule]
    target_prefix: str
    rare_targets: Sequence[str]
    models: Sequence[ModelSpec] = field(default_factory=default_models)
    searches: Sequence[Search] = field(default_factory=default_searches)
    baseline: str = "ridge"
    explained: str = "boosted"
    folds: int = 5
    holdout: float = 0.2
    horizons: Sequence[int] = (0, 6, 24)
    seeds: Sequence[int] = (0, 1, 2, 3, 4)
    common: tuple[float, float, int] = (0.02, 0.4, 3)
    rare: tuple[float, float, int] = (0.006, 0.2, 4)
    sample: int = 2000
    parallelism: int = 4


def _explain(model, test: DataFrame, table: TrainingTable, size: int) -> DataFrame:
    sample = sample_rows(test, size, [table.pos])
    return attribution_ranking(tree_attributions(model, sample, table.features, table.pos))


def analyse(raw: DataFrame, plan: Analysis) -> Mapping[str, DataFrame]:
    """All result tables by name. ``raw`` holds the unfilled label, the features
    and the columns that the item rules read."""
    label = plan.features.label
    df, order = prepare_series(raw, plan.order)
    filled = materialise(complete_rows(interpolate_linear(df, label, order), [label]).select(*raw.columns), "filled")
    out = {f"profile_{name}": t for name, t in profile(raw, filled, plan.profile).items()}

    spec = with_levels(raw, plan.features)
    names = [m.name for m in plan.models]
    tables = horizon_tables(df, spec, order, sorted({0, *plan.horizons}))
    table = tables[0]
    out["feature_table"] = describe_frame(table.df, table.pos, table.features)

    by_horizon = []
    for h in plan.horizons:
        summary, folds = cv_benchmark(tables[h], plan.models, plan.folds, plan.baseline, plan.parallelism)
        by_horizon.append(summary.withColumn("horizon", F.lit(h)))
        if h == 0:
            out["cv_summary"], out["cv_fold_scores"] = summary, folds
            out["significance"] = significance_vs_baseline(folds, names, plan.baseline)
    out["horizon_scores"] = by_horizon[0]
    for other in by_horizon[1:]:
        out["horizon_scores"] = out["horizon_scores"].unionByName(other)

    cut = holdout_start(table.rows, plan.holdout)
    train, test = table.first(cut), table.between(cut, table.rows)
    scores, fitted = holdout_benchmark(table, plan.models, plan.holdout, plan.parallelism)
    out["holdout_scores"] = scores = materialise(scores, "holdout-scores")

    out["best_parameters"], _, tuned = tune_all(train, plan.searches, plan.parallelism)
    parts = [score(m, test).withColumn("algorithm", F.lit(name)) for name, m in tuned.items()]
    predicted = parts[0]
    for other in parts[1:]:
        predicted = predicted.unionByName(other)
    tuned_scores = materialise(regression_scores(predicted, table.label, by=["algorithm"]), "tuned-scores")
    out["untuned_and_tuned"] = compare_scores(scores, tuned_scores)

    per_seed = materialise(
        seed_robustness(table, plan.models, plan.seeds, plan.holdout, parallelism=plan.parallelism), "seed-scores"
    )
    out["seed_scores"], out["seed_summary"] = per_seed, summarise_seeds(per_seed)

    marked = tuned_scores.withColumn("algorithm", F.concat("algorithm", F.lit(" [Tuned]")))
    best = best_of_tuned(scores, marked).first()["algorithm"]
    winner = tuned[best.removesuffix(" [Tuned]")] if best.endswith(" [Tuned]") else fitted[best]
    shown = score(winner, test).select(table.pos, table.label, "prediction")
    out["actual_and_predicted"] = head_by_time(shown, 500).withColumn("algorithm", F.lit(best))

    out["attribution"] = _explain(tuned.get(plan.explained, fitted[plan.explained]), test, table, plan.sample)
    far = tables[max(plan.horizons)]
    far_cut = holdout_start(far.rows, plan.holdout)
    explained = next(m for m in plan.models if m.name == plan.explained)
    out["attribution_far"] = _explain(
        fit(explained, far.first(far_cut)), far.between(far_cut, far.rows), far, plan.sample
    )

    baskets = to_baskets(discretize(filled, plan.items), [r.attr for r in plan.items])
    out["rules_common"], out["rules_rare"] = common_and_rare_rules(
        baskets, plan.target_prefix, plan.rare_targets, plan.common, plan.rare, weight="w"
    )
    return out


def write_analysis(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Write every result table to its own folder."""
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}", fmt)
