from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from chronolode.operators.attribution import (
    attribution_ranking,
    linear_attributions,
    sample_rows,
    tree_attributions,
    tree_nodes,
)
from chronolode.operators.benchmark import (
    cv_benchmark,
    cv_fold_scores,
    fold_predictions,
    holdout_benchmark,
    horizon_benchmark,
    seed_robustness,
)
from chronolode.operators.features import FeatureSpec
from chronolode.operators.models import assembled, boosted, default_models, fit, forest, ridge, score, training_table, tree
from chronolode.operators.ordering import TimeOrder, fold_of, fold_starts
from chronolode.operators.ridge import column_means, ridge_coefficients, sums_of_products
from chronolode.operators.tuning import (
    BOOSTED_SPACE,
    RIDGE_GRID,
    Integers,
    Search,
    Uniform,
    default_searches,
    grid_points,
    grid_search,
    random_points,
    random_search,
    tune_all,
)

FEATURES = ["a", "b", "c"]
N = 600


def data():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(50, 3, N), rng.integers(0, 9, N), rng.normal(-1, 0.01, N)])
    y = 3 * x[:, 0] - 2 * (x[:, 1] > 4) * x[:, 1] + rng.normal(size=N)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = data()
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "t int, a double, b double, c double, label double")
    return training_table(df.repartition(5), TimeOrder("t"), FEATURES)


def closed_form(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my - b @ mx, b


@pytest.mark.parametrize("alpha", [0.1, 50.0, 1e4])
def test_ridge_equals_the_closed_form(table, alpha):
    x, y = data()
    b0, b = closed_form(x, y, alpha)
    model = fit(ridge(alpha), table).stages[-1]
    assert np.allclose(model.coefficients.toArray(), b, rtol=1e-6) and model.intercept == pytest.approx(b0, rel=1e-6)
    terms = {r["term"]: r["value"] for r in ridge_coefficients(table, [alpha]).collect()}
    assert np.allclose([terms[f] for f in FEATURES], b, rtol=1e-8) and terms["intercept"] == pytest.approx(b0, rel=1e-8)


def test_both_ways_to_sum_products_agree(table):
    center = column_means(table)
    segment = fold_of(F.col("pos"), N, 3)
    few, many = (sums_of_products(table, segment, center, limit) for limit in (90, 0))
    assert set(few) == set(many) == {0, 1, 2, 3}
    assert all(np.allclose(few[s], many[s], rtol=1e-12, atol=1e-9) for s in few)


def test_shared_ridge_pass_equals_single_fits(table):
    x, y = data()
    starts, size = fold_starts(N, 5)
    got = fold_predictions(table, [ridge(1.0, "r1"), ridge(100.0, "r2")], 5)
    rows = {(r["algorithm"], r["fold"]): r for r in cv_fold_scores(table, [ridge(1.0, "r1"), ridge(100.0, "r2")], 5).collect()}
    assert got.count() == 2 * 5 * size
    for (name, alpha), f in [(m, f) for m in (("r1", 1.0), ("r2", 100.0)) for f in range(5)]:
        at = slice(starts[f], starts[f] + size)
        b0, b = closed_form(x[: starts[f]], y[: starts[f]], alpha)
        error = y[at] - (b0 + x[at] @ b)
        assert rows[name, f + 1]["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
        assert rows[name, f + 1]["mae"] == pytest.approx(np.abs(error).mean())
        assert rows[name, f + 1]["r2"] == pytest.approx(1 - (error**2).mean() / y[at].var())


def test_equal_seeds_give_equal_trees(spark, table, partitions):
    def predictions():
        model = fit(forest(trees=4, max_depth=4, seed=3), table)
        return [r["prediction"] for r in score(model, table.df).orderBy("pos").collect()]

    first = predictions()
    partitions(3)
    assert predictions() == first


def test_many_fits_put_their_vectors_together_once(table, monkeypatch):
    called, plain = [], VectorAssembler._transform
    monkeypatch.setattr(VectorAssembler, "_transform", lambda self, df: called.append(1) or plain(self, df))
    models = [tree(max_depth=2), forest(trees=3, max_depth=3), boosted(rounds=2, max_depth=2)]
    scored = fold_predictions(table, models, 2)
    assert len(called) == 1
    starts, size = fold_starts(N, 2)
    for spec in models:
        for f, start in enumerate(starts):
            alone = score(fit(spec, table.first(start)), table.between(start, start + size))
            got = scored.where((F.col("algorithm") == spec.name) & (F.col("fold") == f + 1))
            assert sorted(got.select("label", "prediction").collect()) == sorted(alone.select("label", "prediction").collect())


def test_a_fit_on_vectors_takes_rows_with_plain_features(table):
    for spec in (ridge(3.0), forest(trees=2, max_depth=3)):
        whole, plain = (fit(spec, t.first(400)) for t in (assembled(table), table))
        some = table.between(400, N)
        assert [r.prediction for r in score(whole, some).collect()] == pytest.approx([r.prediction for r in score(plain, some).collect()])


def test_boosting_rate_is_the_share_of_the_residual(table):
    x, y = data()
    one = fit(boosted(rounds=1, rate=0.3, max_depth=2, rows=1.0, cols=1.0), table)
    two = fit(boosted(rounds=2, rate=0.3, max_depth=2, rows=1.0, cols=1.0), table)
    p1, p2 = (np.array([r["prediction"] for r in score(m, table.df).orderBy("pos").collect()]) for m in (one, two))
    step = p2 - p1
    # within a leaf of the second tree the step is 0.3 of the mean residual
    for leaf in np.unique(step.round(9)):
        rows = np.abs(step - leaf) < 1e-6
        assert step[rows][0] == pytest.approx(0.3 * (y - p1)[rows].mean(), rel=1e-6)


def shapley(nodes, x, features):
    """Brute force over coalitions of the path-following expectation of one tree."""
    by_id = {n["id"]: n for n in nodes}

    def value(known, at=0):
        n = by_id[at]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return value(known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        return sum(by_id[c]["cover"] / n["cover"] * value(known, c) for c in (n["left"], n["right"]))

    m = features
    phi = np.zeros(m)
    for j in range(m):
        others = [i for i in range(m) if i != j]
        for k in range(m):
            for s in combinations(others, k):
                weight = factorial(k) * factorial(m - k - 1) / factorial(m)
                phi[j] += weight * (value({*s, j}) - value(set(s)))
    return phi, value(set())


def test_attributions_equal_brute_force(spark, table):
    model = fit(tree(max_depth=5, min_leaf=3), table)
    nodes = tree_nodes(spark, model).collect()
    x, _ = data()
    few = table.df.where("pos < 15")
    got = {}
    for r in tree_attributions(model, few, FEATURES, "pos").collect():
        got.setdefault(r["pos"], {})[r["feature"]] = (r["phi"], r["base"])
    for pos, cells in got.items():
        phi, base = shapley(nodes, x[pos], 3)
        assert np.allclose([cells[f][0] for f in FEATURES], phi, atol=1e-9)
        assert cells["a"][1] == pytest.approx(base)


@pytest.mark.parametrize("spec", [tree(max_depth=6), forest(trees=5, max_depth=5), boosted(rounds=6, max_depth=4)])
def test_attributions_add_up_to_the_prediction(table, spec):
    model = fit(spec, table)
    total = (
        tree_attributions(model, table.df, FEATURES, "pos")
        .groupBy("pos")
        .agg((F.sum("phi") + F.first("base")).alias("total"))
    )
    gap = score(model, table.df).join(total, "pos").agg(F.max(F.abs(F.col("prediction") - F.col("total")))).first()[0]
    assert gap < 1e-8


def test_linear_attributions_and_ranking(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 20.0)], "id int, x double, y double")
    phi = linear_attributions({"x": 2.0, "y": -1.0}, df, "id")
    assert {(r["id"], r["feature"]): r["phi"] for r in phi.collect()} == {
        (1, "x"): -2.0, (1, "y"): 5.0, (2, "x"): 2.0, (2, "y"): -5.0,
    }
    assert [r["feature"] for r in attribution_ranking(phi).collect()] == ["y", "x"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    first = {r["id"] for r in sample_rows(df, 50, ["id"], 1).collect()}
    assert len(first) == 50
    assert first == {r["id"] for r in sample_rows(df.repartition(13), 50, ["id"], 1).collect()}
    assert first != {r["id"] for r in sample_rows(df, 50, ["id"], 2).collect()}
    assert sample_rows(df, 1000, ["id"]).count() == 500


def test_benchmarks(table):
    models = [ridge(), tree(max_depth=4), forest(trees=3, max_depth=4), boosted(rounds=3, max_depth=3)]
    summary, folds = cv_benchmark(table, models, k=3)
    rows = summary.collect()
    assert [r["r2"] for r in rows] == sorted((r["r2"] for r in rows), reverse=True)
    assert folds.count() == 12
    assert next(r["gain"] for r in rows if r["algorithm"] == "ridge") == 0
    scores, fitted = holdout_benchmark(table, models)
    assert set(fitted) == {"ridge", "tree", "forest", "boosted"} and scores.count() == 4
    assert scores.where("algorithm = 'tree'").first()["r2"] > 0.5


def test_seeds(table):
    rows = seed_robustness(table, [ridge(), forest(trees=8, max_depth=3)], seeds=(0, 1, 2), forest_trees=2).collect()
    by_model = {}
    for r in rows:
        by_model.setdefault(r["algorithm"], {})[r["seed"]] = r["r2"]
    assert len(set(by_model["ridge"].values())) == 1 and len(by_model["ridge"]) == 3
    assert len(set(by_model["forest"].values())) == 3


def test_searches(table):
    best = grid_search(table, ridge(), {"alpha": [1.0, 1e9]}, k=3)
    assert best.best_params == {"alpha": 1.0} and best.candidates.count() == 2
    drawn = random_search(table, tree(), {"max_depth": Integers(2, 6)}, draws=3, k=2, seed=5)
    assert drawn.cv_rmse == drawn.candidates.agg(F.min("mean_rmse")).first()[0]
    searches = [Search(ridge(), {"alpha": [0.1]}), Search(tree(), {"max_depth": [3, None]}, folds=2)]
    params, found, fitted = tune_all(table, searches)
    assert {r["algorithm"]: r["best_params"] for r in params.collect()}["ridge"] == {"alpha": "0.1"}
    assert set(fitted) == set(found) == {"ridge", "tree"}


def test_search_spaces():
    assert len(grid_points(RIDGE_GRID)) == 7
    assert [len(grid_points(s.space)) if s.draws is None else s.draws for s in default_searches()] == [7, 24, 4, 15]
    points = random_points(BOOSTED_SPACE, 200, 1)
    assert points == random_points(BOOSTED_SPACE, 200, 1) != random_points(BOOSTED_SPACE, 200, 2)
    assert {p["max_depth"] for p in points} == set(range(3, 8))
    assert all(0.02 <= p["rate"] <= 0.15 and 0.6 <= p["rows"] <= 1.0 for p in points)
    assert {p["f"] for p in random_points({"f": [0.5, "sqrt"], "u": Uniform(0, 1)}, 50)} == {0.5, "sqrt"}


def test_default_models_are_the_published_ones():
    by_name = {m.name: m for m in default_models()}
    assert by_name["ridge"].params == {"alpha": 1.0}
    assert by_name["tree"].params["max_depth"] == 10
    assert (by_name["forest"].params["trees"], by_name["forest"].params["max_depth"]) == (200, 12)
    assert [by_name["boosted"].params[k] for k in ("rounds", "rate", "max_depth", "rows", "cols")] == [400, 0.05, 6, 0.8, 0.8]
    assert all(m.seed == 42 for m in by_name.values())


def test_horizons_are_harder_further_ahead(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(size=400))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(walk)], "t int, y double")
    spec = FeatureSpec("y", lags=(1, 2), windows=(6,), calendar=False)
    rows = horizon_benchmark(df, spec, TimeOrder("t"), [0, 6], [ridge(), ridge(1e6, "heavy")], k=3).collect()
    scores = {(r["horizon"], r["algorithm"]): r for r in rows}
    assert scores[0, "ridge"]["rmse"] < scores[6, "ridge"]["rmse"]
    assert scores[6, "heavy"]["gain"] == pytest.approx(scores[6, "heavy"]["r2"] - scores[6, "ridge"]["r2"])
