"""Catalog: fits, benchmarks, searches, tests and attributions.

SQL states the same result wherever it can solve the same model: ridge on two
features, and trees of one or two levels over whole-number features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.operators import many_fits
from chronolode.operators.attribution import (
    attribution_ranking,
    linear_attributions,
    sample_rows,
    tree_attributions,
)
from chronolode.operators.benchmark import (
    cv_benchmark,
    cv_fold_scores,
    holdout_benchmark,
    holdout_predictions,
    horizon_benchmark,
    seed_robustness,
)
from chronolode.operators.features import build_features
from chronolode.operators.models import (
    TrainingTable,
    boosted,
    default_models,
    fit,
    forest,
    ridge,
    score,
    training_table,
    tree,
)
from chronolode.operators.ordering import holdout_start, prepare_series
from chronolode.operators.ridge import ridge_coefficients
from chronolode.operators.scoring import (
    best_model,
    best_of_tuned,
    compare_scores,
    fold_lists_to_rows,
    gain_vs_baseline,
    mean_scores,
    regression_scores,
    summarise_seeds,
    unpivot_scores,
)
from chronolode.operators.series import add_lags
from chronolode.operators.significance import (
    paired_scores,
    paired_t_test,
    paired_tests,
    pivot_scores,
    score_pairs,
    significance_vs_baseline,
    wilcoxon_signed_rank,
)
from chronolode.operators.tuning import (
    RIDGE_GRID,
    Integers,
    Search,
    default_searches,
    grid_search,
    random_search,
    tune_all,
)
from chronolode.plans.inputs import (
    FOLD_SCORES,
    HOURLY_ORDER,
    HOURLY_SPEC,
    ORDER_FACTS,
    ORDER_FEATURES,
    ORDERS_ORDER,
    PAIR_SPEC,
    SCORE_NAMES,
    SCORES_LONG,
    USER_ORDER,
    USER_SPEC,
    fold_scores,
    hourly,
    order_facts,
    pair_features_sql,
    user_events,
)
from chronolode.plans.registry import query, rounded, steady, steady_sql
from chronolode.sources.scratch import materialise
from chronolode.sources.tables import load

_SCORES = ("mae", "rmse", "r2")
_SCORE_SQL = (
    "round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, "
    "round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2"
)


def pair_table(spark: SparkSession, sf_dir: str) -> TrainingTable:
    df, order = prepare_series(user_events(spark, sf_dir), USER_ORDER)
    return training_table(build_features(df, PAIR_SPEC, order), order, PAIR_SPEC.columns)


def order_table(spark: SparkSession, sf_dir: str) -> TrainingTable:
    return training_table(order_facts(spark, sf_dir), ORDERS_ORDER, ORDER_FEATURES)


def user_table(spark: SparkSession, sf_dir: str) -> TrainingTable:
    df, order = prepare_series(user_events(spark, sf_dir), USER_ORDER)
    return training_table(build_features(df, USER_SPEC, order), order, USER_SPEC.columns)


def hourly_table(spark: SparkSession, sf_dir: str) -> TrainingTable:
    df, order = prepare_series(hourly(spark, sf_dir), HOURLY_ORDER)
    return training_table(build_features(df, HOURLY_SPEC, order), order, HOURLY_SPEC.columns)


def solve_sql(rows: str, by: str, alpha: str) -> str:
    """Two-feature ridge by Cramer's rule over ``rows(by, a, b, y)``: columns
    ``by, b0, b1, b2``."""
    keys = f"{by}, " if by else ""
    return f"""select {keys}my - b1 * ma - b2 * mb as b0, b1, b2 from (
      select *, (say * (sbb + al) - sby * sab) / ((saa + al) * (sbb + al) - sab * sab) as b1,
                (sby * (saa + al) - say * sab) / ((saa + al) * (sbb + al) - sab * sab) as b2
      from (select {keys}{alpha} as al, avg(a) as ma, avg(b) as mb, avg(y) as my,
              var_pop(a) * count(*) as saa, var_pop(b) * count(*) as sbb, covar_pop(a, b) * count(*) as sab,
              covar_pop(a, y) * count(*) as say, covar_pop(b, y) * count(*) as sby
            from {rows} {'group by ' + by if by else ''}))"""


def folds_sql(alphas: list[float], k: int = 5, limit: str = "n", horizons: tuple[int, ...] = (0,)) -> str:
    """``fold_scored``: scores of every alpha and horizon on every fold, over the
    first ``limit`` rows."""
    listed = ", ".join(f"({a})" for a in alphas)
    return f"""{pair_features_sql(horizons)},
part as (select horizon, pos, a, b, y, m from (select *, {limit} as m from pairs) where pos < m),
fold as (select cast(unnest(generate_series(1, {k})) as int) as fold),
train_rows as (select part.*, fold, alpha from part cross join fold cross join (values {listed}) v(alpha)
  where pos < m - ({k} + 1 - fold) * (m // ({k} + 1))),
coefs as ({solve_sql('train_rows', 'horizon, fold, alpha', 'any_value(alpha)')}),
fold_scored as (
  select horizon, fold, alpha, {_SCORE_SQL.replace('round(', '(').replace(', 6)', ')')} from (
    select part.horizon, coefs.fold, alpha, y, b0 + b1 * a + b2 * b as p from part join coefs on coefs.horizon = part.horizon
      and pos >= m - ({k} + 1 - coefs.fold) * (m // ({k} + 1)) and pos < m - ({k} - coefs.fold) * (m // ({k} + 1)))
  group by 1, 2, 3)"""


_ROUND = "round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2"


# --- ridge -----------------------------------------------------------------


@query(
    f"with {pair_features_sql()}, c as ({solve_sql('(select * from pairs)', '', '50.0')}) "
    "select 50.0::double as alpha, 'intercept' as term, round(b0, 6) as value from c "
    "union all select 50.0, 'lag_1', round(b1, 6) from c union all select 50.0, 'roll_mean_6', round(b2, 6) from c"
)
def ridge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ridge_coefficients(pair_table(spark, sf_dir), [50.0]), "value")


_HOLDOUT = "cast(floor(n * cast(0.8 as double)) as bigint)"


def _holdout_sql(alpha: float) -> str:
    return (
        f"with {pair_features_sql()}, c as ({solve_sql(f'(select * from pairs where pos < {_HOLDOUT})', '', str(alpha))}), "
        f"scored as (select pos, y, b0 + b1 * a + b2 * b as p from pairs cross join c where pos >= {_HOLDOUT})"
    )


@query(f"{_holdout_sql(50.0)} select 'ridge' as algorithm, {_SCORE_SQL} from scored")
def ridge_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = holdout_benchmark(pair_table(spark, sf_dir), [ridge(50.0)])
    return rounded(scores, *_SCORES)


@query(f"{_holdout_sql(1.0)} select pos, {steady_sql('y')} as label, {steady_sql('p')} as prediction from scored")
def ridge_batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pair_table(spark, sf_dir)
    cut = holdout_start(table.rows)
    scored = score(fit(ridge(1.0), table.first(cut)), table.between(cut, table.rows))
    return steady(scored.select("pos", "label", "prediction"), "label", "prediction")


@query(f"with {folds_sql([1.0])} select 'ridge' as algorithm, fold, {_ROUND} from fold_scored")
def ridge_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cv_fold_scores(pair_table(spark, sf_dir), [ridge()]), *_SCORES)


@query(
    f"with {folds_sql([1.0, 100000.0])}, s as (select case alpha when 1 then 'ridge' else 'heavy' end as algorithm, "
    "avg(mae) as mae, avg(rmse) as rmse, avg(r2) as r2 from fold_scored group by 1) "
    f"select algorithm, {_ROUND}, round(r2 - (select r2 from s where algorithm = 'ridge'), 6) as gain from s"
)
def expanding_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = cv_benchmark(pair_table(spark, sf_dir), [ridge(), ridge(100000.0, "heavy")])
    return rounded(summary, *_SCORES, "gain")


_TRAIN_PART = "cast(floor(n * cast(0.8 as double)) as bigint)"


@query(
    f"with {folds_sql(RIDGE_GRID['alpha'], limit=_TRAIN_PART)} select alpha::double as alpha, round(avg(rmse), 6) as mean_rmse from fold_scored group by 1"
)
def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pair_table(spark, sf_dir)
    found = grid_search(table.first(holdout_start(table.rows)), ridge(), RIDGE_GRID)
    return rounded(
        found.candidates.select(F.col("params")["alpha"].cast("double").alias("alpha"), "mean_rmse"), "mean_rmse"
    )


@query(
    f"with {folds_sql([1.0, 100000.0], limit=_TRAIN_PART)} select 'ridge' as algorithm, "
    "'{\"alpha\":\"' || cast(cast(alpha as decimal(10,1)) as varchar) || '\"}' as best_params, round(avg(rmse), 6) as cv_rmse "
    "from fold_scored group by alpha order by avg(rmse) limit 1"
)
def best_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pair_table(spark, sf_dir)
    searches = [Search(ridge(), {"alpha": [1.0, 100000.0]})]
    best, _, _ = tune_all(table.first(holdout_start(table.rows)), searches)
    return rounded(best.withColumn("best_params", F.to_json("best_params")), "cv_rmse")


@query(
    f"with {folds_sql([1.0, 100000.0], horizons=(0, 6, 24))}, "
    "s as (select cast(horizon as int) as horizon, case alpha when 1 then 'ridge' else 'heavy' end as algorithm, "
    "avg(mae) as mae, avg(rmse) as rmse, avg(r2) as r2 from fold_scored group by 1, 2) "
    f"select horizon, algorithm, {_ROUND}, round(r2 - max(case when algorithm = 'ridge' then r2 end) over (partition by horizon), 6) as gain from s"
)
def horizon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(user_events(spark, sf_dir), USER_ORDER)
    models = [ridge(), ridge(100000.0, "heavy")]
    return rounded(horizon_benchmark(df, PAIR_SPEC, order, [0, 6, 24], models), *_SCORES, "gain")


# --- trees -----------------------------------------------------------------


def _best_splits(rows: str, nodes: str, target: str) -> str:
    """Best variance split of each node of ``rows(node, m, d, p, target)``."""
    return f"""select node, arg_max(f, gain) as f, arg_max(cut, gain) as cut from (
      select node, f, (v + lead(v) over w) / 2.0 as cut,
        case when lead(v) over w is not null then
          (sum(s) over u) * (sum(s) over u) / (sum(c) over u)
          + (sum(s) over w2 - sum(s) over u) * (sum(s) over w2 - sum(s) over u) / (sum(c) over w2 - sum(c) over u) end as gain
      from (select node, f, v, count(*) as c, sum(t) as s from (
              select {nodes} as node, 'm' as f, m as v, {target} as t from {rows}
              union all select {nodes}, 'd', d, {target} from {rows}
              union all select {nodes}, 'p', p, {target} from {rows}) group by 1, 2, 3)
      window w as (partition by node, f order by v),
             u as (partition by node, f order by v rows between unbounded preceding and current row),
             w2 as (partition by node, f)) where gain is not null group by node"""


_GO_RIGHT = "cast((case {s}.f when 'm' then {r}.m when 'd' then {r}.d else {r}.p end) > {s}.cut as int)"

_STUMP = f"""{ORDER_FACTS},
s1 as ({_best_splits('train', '0', 'y')}),
t1 as (select facts.*, {_GO_RIGHT.format(s='s1', r='facts')} as n1, pos < cast(floor(n * 0.8) as bigint) as is_train from facts cross join s1)"""

_TREE2 = f"""{_STUMP},
s2 as ({_best_splits('(select * from t1 where is_train)', 'n1', 'y')}),
t2 as (select t1.*, {_GO_RIGHT.format(s='s2', r='t1')} as n2 from t1 join s2 on s2.node = t1.n1),
leaves as (select n1, n2, avg(y) as p from t2 where is_train group by 1, 2),
scored as (select t2.pos, t2.y, leaves.p from t2 join leaves on leaves.n1 = t2.n1 and leaves.n2 = t2.n2 where not is_train)"""


@query(f"with {_TREE2} select 'tree' as algorithm, {_SCORE_SQL} from scored")
def tree_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = holdout_benchmark(order_table(spark, sf_dir), [tree(max_depth=2)])
    return rounded(scores, *_SCORES)


@query(f"with {_TREE2} select 'forest' as algorithm, {_SCORE_SQL} from scored")
def forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without row draws every tree of a forest is the same tree."""
    scores, _ = holdout_benchmark(order_table(spark, sf_dir), [forest(trees=3, max_depth=2, bootstrap=False)])
    return rounded(scores, *_SCORES)


@query(
    f"with {_TREE2}, s as (select {_SCORE_SQL} from scored) "
    "select algorithm, cast(seed as int) as seed, mae, rmse, r2 from s cross join (values ('tree'), ('forest')) m(algorithm) "
    "cross join range(3) r(seed)"
)
def seed_scores_without_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that draw nothing score the same under every seed."""
    models = [tree(max_depth=2), forest(trees=2, max_depth=2, bootstrap=False)]
    return rounded(seed_robustness(order_table(spark, sf_dir), models, seeds=(0, 1, 2)), *_SCORES)


@query(
    f"""with {_STUMP},
first_tree as (select n1, avg(y) as p1 from t1 where is_train group by 1),
r1 as (select t1.*, p1, y - p1 as r from t1 join first_tree using (n1)),
s2 as ({_best_splits('(select * from r1 where is_train)', '0', 'r')}),
t2 as (select r1.*, {_GO_RIGHT.format(s='s2', r='r1')} as n2 from r1 cross join s2),
second_tree as (select n2, avg(r) as p2 from t2 where is_train group by 1),
scored as (select pos, y, p1 + 0.5 * p2 as p from t2 join second_tree using (n2) where not is_train)
select 'boosted' as algorithm, {_SCORE_SQL} from scored"""
)
def boosted_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of one-level trees, every row and feature used."""
    spec = boosted(rounds=2, rate=0.5, max_depth=1, rows=1.0, cols=1.0)
    scores, _ = holdout_benchmark(order_table(spark, sf_dir), [spec])
    return rounded(scores, *_SCORES)


@query(
    f"with {_STUMP}, leaf as (select n1, avg(y) as v from t1 where is_train group by 1), "
    "b as (select avg(y) as base from t1 where is_train) "
    "select pos, feature, value, round(case when feature = s1.f then leaf.v - base else 0 end, 6) as phi, round(base, 6) as base "
    "from (select t1.pos, t1.n1, u.feature, u.value::double as value from t1, "
    "lateral (values ('m', t1.m), ('d', t1.d), ('p', t1.p)) u(feature, value) where not is_train) x "
    "join leaf on leaf.n1 = x.n1 cross join b cross join s1"
)
def stump_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = order_table(spark, sf_dir)
    cut = holdout_start(table.rows)
    model = fit(tree(max_depth=1), table.first(cut))
    phi = tree_attributions(model, table.between(cut, table.rows), table.features, table.pos)
    return rounded(phi, "phi", "base")


@query(
    f"with {ORDER_FACTS} select least(2000, count(*)) as n_rows, least(2000, count(*)) as n_equal from facts "
    "where pos >= cast(floor(n * 0.8) as bigint)"
)
def forest_attributions_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled holdout rows, and those whose contributions and base make the
    prediction of a drawn forest."""
    table = order_table(spark, sf_dir)
    cut = holdout_start(table.rows)
    model = fit(forest(trees=20, max_depth=8), table.first(cut))
    sample = materialise(sample_rows(table.between(cut, table.rows), 2000, [table.pos]), "sample")
    phi = tree_attributions(model, sample, table.features, table.pos)
    sums = phi.groupBy(table.pos).agg((F.first("base") + F.sum("phi")).alias("added"))
    both = score(model, sample).join(sums, table.pos)
    equal = F.abs(F.col("added") - F.col("prediction")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(equal).alias("n_equal"))


@query()
def boosted_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute attribution per feature of a boosted model on a sample of
    the holdout rows."""
    table = user_table(spark, sf_dir)
    cut = holdout_start(table.rows)
    model = fit(boosted(rounds=5, max_depth=4), table.first(cut))
    sample = sample_rows(table.between(cut, table.rows), 2000, [table.pos])
    return attribution_ranking(tree_attributions(model, sample, table.features, table.pos))


@query()
def horizon_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking for a target 24 rows further ahead."""
    df, order = prepare_series(user_events(spark, sf_dir), USER_ORDER)
    table = training_table(build_features(df, USER_SPEC, order, horizon=24), order, USER_SPEC.columns)
    cut = holdout_start(table.rows)
    model = fit(boosted(rounds=5, max_depth=4), table.first(cut))
    sample = sample_rows(table.between(cut, table.rows), 2000, [table.pos])
    return attribution_ranking(tree_attributions(model, sample, table.features, table.pos))


@query(
    f"with {pair_features_sql()}, m as (select avg(a) as ma, avg(b) as mb from pairs) "
    f"select pos, 'lag_1' as feature, {steady_sql('a')} as value, {steady_sql('0.25 * (a - ma)')} as phi from pairs cross join m "
    f"union all select pos, 'roll_mean_6', {steady_sql('b')}, {steady_sql('-0.5 * (b - mb)')} from pairs cross join m"
)
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pair_table(spark, sf_dir)
    return steady(linear_attributions({"lag_1": 0.25, "roll_mean_6": -0.5}, table.df, table.pos), "value", "phi")


@query(
    "with m as (select avg(l_quantity) as a, avg(l_discount) as b from lineitem) "
    "select 'l_discount' as feature, round(avg(abs(100 * (l_discount - b))), 6) as mean_abs_phi from lineitem cross join m "
    "union all select 'l_quantity', round(avg(abs(2.0 * (l_quantity - a))), 6) from lineitem cross join m"
)
def attribution_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = linear_attributions({"l_quantity": 2.0, "l_discount": 100.0}, load(spark, sf_dir, "lineitem"), "l_orderkey")
    return rounded(attribution_ranking(phi), "mean_abs_phi")


@query("select event_id, value from events order by md5('42-' || event_id), event_id limit 2000")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(load(spark, sf_dir, "events").select("event_id", "value"), 2000, ["event_id"])


# --- scores ----------------------------------------------------------------


@query(
    f"select event_type, {_SCORE_SQL} from (select event_type, value as y, "
    "lag(value) over (partition by user_id order by ts, event_id) as p from events) where p is not null group by 1"
)
def naive_forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per event type of the forecast that repeats the previous value."""
    ev = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    df, order = prepare_series(ev, USER_ORDER)
    lagged = add_lags(df, "value", [1], order).where(F.col("lag_1").isNotNull())
    return rounded(regression_scores(lagged, "value", "lag_1", by=["event_type"]), *_SCORES)


@query(
    f"with {FOLD_SCORES}, s as (select algorithm, avg(mae) as mae, avg(rmse) as rmse, avg(r2) as r2 from fold_scores group by 1) "
    f"select algorithm, {_ROUND}, round(r2 - (select r2 from s where algorithm = 'click'), 6) as gain from s"
)
def gain_over_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gain_vs_baseline(mean_scores(fold_scores(spark, sf_dir)), "click"), *_SCORES, "gain")


@query(f"with {SCORES_LONG} select algorithm, fold, metric, value from scores")
def scores_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot_scores(fold_scores(spark, sf_dir))


@query(f"with {FOLD_SCORES} select algorithm, cast(fold as int) as fold, mae, rmse, r2 from fold_scores")
def scores_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("fold", *_SCORES)))  # five folds per model
    lists = fold_scores(spark, sf_dir).groupBy("algorithm").agg(in_order.alias("s"))
    return fold_lists_to_rows(lists.select("algorithm", *[F.col(f"s.{m}").alias(m) for m in _SCORES]))


@query(f"with {FOLD_SCORES} select * from fold_scores order by r2 desc, algorithm limit 1")
def best_by_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_model(fold_scores(spark, sf_dir))


# Ridge with a light and with a heavy penalty, before and after a grid of its own.
_TUNED_GRIDS = {"ridge": (1.0, RIDGE_GRID["alpha"]), "heavy": (100000.0, [1000.0, 10000.0, 100000.0])}


def _tuned_sql() -> str:
    """``scored``: holdout scores by model and whether it is tuned, not rounded."""
    alphas = sorted({a for first, grid in _TUNED_GRIDS.values() for a in (first, *grid)})
    picks = " union all ".join(
        f"select '{m}' as model, 0 as tuned, {first}::double as alpha union all "
        f"select '{m}', 1, (select alpha from means where alpha in ({', '.join(map(str, grid))}) order by rmse, alpha limit 1)"
        for m, (first, grid) in _TUNED_GRIDS.items()
    )
    return f"""{folds_sql(alphas, limit=_TRAIN_PART)},
means as (select alpha, avg(rmse) as rmse from fold_scored group by 1),
picks as ({picks}),
fitted as ({solve_sql(f"(select pairs.*, model, tuned, alpha from pairs cross join picks where pos < {_HOLDOUT})", "model, tuned", "any_value(alpha)")}),
scored as (
  select model, tuned, {_SCORE_SQL.replace('round(', '(').replace(', 6)', ')')}
  from (select model, tuned, y, b0 + b1 * a + b2 * b as p from pairs cross join fitted where pos >= {_HOLDOUT}) group by 1, 2)"""


def _untuned_and_tuned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Holdout scores of both models before and after their grids on the training part."""
    table = pair_table(spark, sf_dir)
    train = table.first(holdout_start(table.rows))
    searches = [Search(ridge(first, name), {"alpha": list(grid)}) for name, (first, grid) in _TUNED_GRIDS.items()]
    _, found, _ = tune_all(train, searches, refit=None)
    before, _ = holdout_benchmark(table, [s.model for s in searches])
    after, _ = holdout_benchmark(table, [found[s.model.name].best for s in searches])
    return before, after


@query(f"with {_tuned_sql()} select model || case tuned when 1 then ' [Tuned]' else '' end as algorithm, {_ROUND} from scored")
def untuned_and_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare_scores(*_untuned_and_tuned(spark, sf_dir)), *_SCORES)


@query(f"with {_tuned_sql()} select model as algorithm, {_ROUND} from scored order by scored.r2 desc, tuned, model limit 1")
def best_after_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(best_of_tuned(*_untuned_and_tuned(spark, sf_dir)), *_SCORES)


@query(
    f"with {FOLD_SCORES} select algorithm, "
    + ", ".join(
        f"round(avg({m}), 6) as {m}_mean, round(stddev_pop({m}), 6) as {m}_std, round(min({m}), 6) as {m}_min, "
        f"round(max({m}), 6) as {m}_max, round(max({m}) - min({m}), 6) as {m}_range"
        for m in ("r2", "rmse", "mae")
    )
    + ", count(distinct fold) as n_seeds from fold_scores group by 1"
)
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_seed = fold_scores(spark, sf_dir).withColumnRenamed("fold", "seed")
    summary = summarise_seeds(per_seed)
    return rounded(summary, *[c for c in summary.columns if c not in ("algorithm", "n_seeds")])


# --- tests -----------------------------------------------------------------


@query(f"with {SCORES_LONG} select fold, " + ", ".join(f"max(value) filter (where algorithm = '{a}') as {a}" for a in SCORE_NAMES) + " from scores where metric = 'r2' group by 1")
def scores_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_scores(fold_scores(spark, sf_dir), "r2", SCORE_NAMES)


_PAIRS = (
    f"{SCORES_LONG}, pairs as (select a.algorithm as model_a, b.algorithm as model_b, metric, fold, a.value as a, b.value as b, "
    "a.value - b.value as d from scores a join scores b using (metric, fold) where a.algorithm {rule})"
)
_VS_CLICK = _PAIRS.format(rule="= 'click' and b.algorithm <> 'click'")
_ALL_PAIRS = _PAIRS.format(rule="< b.algorithm")


@query(f"with {_ALL_PAIRS} select model_a, model_b, metric, fold, a, b from pairs")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = unpivot_scores(fold_scores(spark, sf_dir))
    return paired_scores(long, score_pairs(SCORE_NAMES)).select("model_a", "model_b", "metric", "fold", "a", "b")


# With five folds: Student's t with four degrees of freedom in closed form, and
# the signed rank null distribution by listing all 32 sign patterns.
_TESTS = """
stat as (select model_a, model_b, metric, count(*) as n, avg(d) as mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t
  from pairs group by 1, 2, 3),
t_test as (select *, 1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) * cos(atan(abs(t) / 2)) / 2) as t_p from stat),
ranked as (select *, rank() over (partition by model_a, model_b, metric order by abs(d)) as r from pairs),
sums as (select model_a, model_b, metric, count(*) as n_nonzero,
  least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w from ranked group by 1, 2, 3),
signs as (select (s & 1) + 2 * ((s >> 1) & 1) + 3 * ((s >> 2) & 1) + 4 * ((s >> 3) & 1) + 5 * ((s >> 4) & 1) as total
  from (select unnest(generate_series(0, 31)) as s)),
w_test as (select *, least(1.0::double, 2 * (select count(*) from signs where total <= w) / 32.0::double) as w_p from sums)"""


@query(
    f"with {_ALL_PAIRS}, {_TESTS} select model_a, model_b, metric, n, round(mean_diff, 9) as mean_diff, round(t, 4) as t_stat, "
    "round(t_p, 6) as t_p from t_test"
)
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = paired_scores(unpivot_scores(fold_scores(spark, sf_dir)), score_pairs(SCORE_NAMES))
    tested = paired_t_test(both, "a", "b", ["model_a", "model_b", "metric"])
    return tested.withColumns(
        {"mean_diff": F.round("mean_diff", 9), "t_stat": F.round("t_stat", 4), "t_p": F.round("t_p", 6)}
    )


@query(
    f"with {_ALL_PAIRS}, {_TESTS} select model_a, model_b, metric, n_nonzero, w::double as w_stat, round(w_p, 6) as w_p from w_test"
)
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = paired_scores(unpivot_scores(fold_scores(spark, sf_dir)), score_pairs(SCORE_NAMES))
    return rounded(wilcoxon_signed_rank(both, "a", "b", ["model_a", "model_b", "metric"]), "w_p")


_TIED = """tied as (select model_a, model_b, metric, fold, round(d, 2) as d from pairs where round(d, 2) <> 0),
ranks as (
  select *, rank() over w + (count(*) over (partition by model_a, model_b, metric, abs(d)) - 1) / 2.0 as r,
    row_number() over (partition by model_a, model_b, metric order by fold) - 1 as i
  from tied window w as (partition by model_a, model_b, metric order by abs(d))),
told as (select model_a, model_b, metric, count(*) as n_nonzero,
  least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w from ranks group by 1, 2, 3),
patterns as (
  select model_a, model_b, metric, s, sum(r * ((s >> i) & 1)) as total
  from ranks cross join (select unnest(generate_series(0, 31)) as s) group by 1, 2, 3, 4),
p as (select model_a, model_b, metric, least(1.0::double, 2 * count_if(total <= w) / 32.0::double) as w_p
  from patterns join told using (model_a, model_b, metric) group by 1, 2, 3)"""


@query(
    f"with {_ALL_PAIRS}, {_TIED} select model_a, model_b, metric, n_nonzero, w::double as w_stat, w_p from "
    "(select distinct model_a, model_b, metric from pairs) left join told using (model_a, model_b, metric) "
    "left join p using (model_a, model_b, metric)"
)
def signed_rank_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to two places, so that some are equal or zero, by exact counting."""
    both = paired_scores(unpivot_scores(fold_scores(spark, sf_dir)), score_pairs(SCORE_NAMES))
    coarse = both.withColumns({"a": F.round(F.col("a") - F.col("b"), 2), "b": F.lit(0.0)})
    return wilcoxon_signed_rank(coarse, "a", "b", ["model_a", "model_b", "metric"], method="exact")


_TEST_ROWS = (
    "select model_a, model_b, metric, round(mean_diff, 9) as mean_diff, case when mean_diff > 0 then model_a else model_b end as higher_mean, "
    "round(t_p, 6) as t_p, round(w_p, 6) as w_p, t_p < 0.05 as significant_t, w_p < 0.05 as significant_w "
    "from t_test join w_test using (model_a, model_b, metric)"
)


def _test_rows(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("mean_diff", F.round("mean_diff", 9)), "t_p", "w_p")


@query(f"with {_VS_CLICK}, {_TESTS} {_TEST_ROWS}")
def tests_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_rows(significance_vs_baseline(fold_scores(spark, sf_dir), SCORE_NAMES, "click"))


@query(f"with {_ALL_PAIRS}, {_TESTS} {_TEST_ROWS} where metric = 'r2'")
def tests_of_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_rows(paired_tests(fold_scores(spark, sf_dir), SCORE_NAMES, metrics=["r2"]))


# --- whole benchmarks with fitted trees: rows only -------------------------


def small_models():
    return [ridge(), tree(max_depth=6), forest(trees=10, max_depth=6), boosted(rounds=5, max_depth=4)]


@query()
def four_model_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four models at their published sizes over five folds."""
    summary, _ = many_fits.cv_benchmark(user_table(spark, sf_dir), default_models(), k=5)
    return summary


@query()
def four_model_benchmark_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = cv_benchmark(hourly_table(spark, sf_dir), small_models(), k=5)
    return summary


@query()
def four_model_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = holdout_benchmark(user_table(spark, sf_dir), small_models())
    return scores


@query()
def actual_and_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 holdout rows of the best model."""
    predicted, _ = holdout_predictions(user_table(spark, sf_dir), [ridge(), tree(max_depth=6)])
    best = best_model(regression_scores(predicted, by=["algorithm"])).first()["algorithm"]
    return predicted.where(F.col("algorithm") == best).orderBy("pos").limit(500)


@query()
def four_model_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(user_events(spark, sf_dir), USER_ORDER)
    models = [ridge(), tree(max_depth=5), forest(trees=5, max_depth=5), boosted(rounds=3, max_depth=3)]
    return horizon_benchmark(df, USER_SPEC, order, [0, 6, 24], models, k=2)


@query()
def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [ridge(), tree(max_depth=6), forest(trees=5, max_depth=5), boosted(rounds=3, max_depth=3)]
    return seed_robustness(user_table(spark, sf_dir), models, seeds=(0, 1, 2))


@query()
def tree_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = user_table(spark, sf_dir)
    grid = {"max_depth": [4, 6], "min_leaf": [1, 20]}
    return grid_search(table.first(holdout_start(table.rows)), tree(), grid, k=2).candidates


@query()
def forest_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = user_table(spark, sf_dir)
    space = {"trees": Integers(5, 15), "max_depth": Integers(3, 7), "features": [0.5, 0.7, "sqrt"]}
    return random_search(table.first(holdout_start(table.rows)), forest(), space, draws=3, k=2).candidates


@query()
def tuned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published searches of the four models."""
    table = user_table(spark, sf_dir)
    best, _, _ = many_fits.tune_all(table.first(holdout_start(table.rows)), default_searches())
    return best
