"""Scores, summaries and paired tests, some against published score tables."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolode.operators.scoring import (
    best_model,
    best_of_tuned,
    compare_scores,
    fold_lists_to_rows,
    gain_vs_baseline,
    mean_scores,
    regression_scores,
    scores_long,
    summarise_seeds,
)
from chronolode.operators.significance import (
    paired_t_test,
    paired_tests,
    pivot_scores,
    score_pairs,
    significance_vs_baseline,
    wilcoxon_signed_rank,
)

SCORES = "algorithm string, mae double, rmse double, r2 double"

# A published holdout score table, MAE / RMSE / R2.
HOLDOUT = [
    ("ridge", 11.60650906526745, 21.052208757461123, 0.9496503366547387),
    ("tree", 12.691867045551282, 23.994239076876298, 0.934594360112677),
    ("forest", 11.46774999206756, 20.934437123854078, 0.9502120996356882),
    ("boosted", 11.572794342599028, 20.959695347073843, 0.9500918850306558),
]
# Published mean fold scores (R2) and gains over ridge.
GAINS = [
    ("ridge", 0.9429233932146499, 0.0),
    ("boosted", 0.932861880135626, -0.01006151307902392),
    ("forest", 0.929169075208096, -0.013754318006553912),
    ("tree", 0.8456325822313907, -0.0972908109832592),
]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 5.0)], "label double, prediction double")
    row = regression_scores(df).first()
    assert row["mae"] == pytest.approx(4 / 3)
    assert row["rmse"] == pytest.approx(math.sqrt(10 / 3))
    assert row["r2"] == pytest.approx(1 - 10 / 26)


def test_r2_of_equal_labels_is_null(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0)], "g string, label double, prediction double")
    rows = {r["g"]: r for r in regression_scores(df, by=["g"]).collect()}
    assert rows["a"]["r2"] is None and rows["a"]["mae"] == 1.0 and rows["b"]["r2"] is None


def test_gain_equals_published_column(spark):
    df = spark.createDataFrame([(a, r2) for a, r2, _ in GAINS], "algorithm string, r2 double")
    got = {r["algorithm"]: r["gain"] for r in gain_vs_baseline(df, "ridge").collect()}
    assert got == pytest.approx({a: g for a, _, g in GAINS}, abs=1e-15)


def test_gain_within_horizon(spark):
    rows = [(0, "ridge", 0.9), (0, "tree", 0.8), (6, "ridge", 0.5), (6, "tree", 0.6)]
    df = spark.createDataFrame(rows, "horizon int, algorithm string, r2 double")
    got = {(r["horizon"], r["algorithm"]): r["gain"] for r in gain_vs_baseline(df, "ridge", by=["horizon"]).collect()}
    assert got == pytest.approx({(0, "ridge"): 0, (0, "tree"): -0.1, (6, "ridge"): 0, (6, "tree"): 0.1})


def test_best_and_comparison(spark):
    untuned = spark.createDataFrame(HOLDOUT, SCORES)
    assert best_model(untuned).first()["algorithm"] == "forest"
    same = spark.createDataFrame([HOLDOUT[2], HOLDOUT[1]], SCORES)
    tuned = same.replace({"forest": "tuned-forest"}, subset=["algorithm"])
    assert best_of_tuned(untuned, tuned).first()["algorithm"] == "forest"  # equal is not better
    both = [r["algorithm"] for r in compare_scores(untuned, same).collect()]
    assert both == ["forest", "forest [Tuned]", "boosted", "ridge", "tree", "tree [Tuned]"]


def test_labels_are_trimmed(spark):
    rows = [("Ridge Regression (Baseline)", 1.0, 2.0, 0.5), ("Decision Tree Regressor [Tuned]", 1.0, 2.0, 0.9)]
    long = scores_long(spark.createDataFrame(rows, SCORES)).collect()
    assert {(r["label"], r["place"]) for r in long} == {("Ridge (Baseline)", 2), ("Decision Tree [Tuned]", 1)}
    assert len(long) == 6


def test_seed_summary_uses_population_deviation(spark):
    seeds = [0.9512, 0.9495, 0.9508]
    rows = [("forest", s, 1.0, 2.0, r2) for s, r2 in enumerate(seeds)] + [("ridge", s, 1.0, 2.0, 0.94) for s in range(3)]
    got = summarise_seeds(spark.createDataFrame(rows, "algorithm string, seed int, mae double, rmse double, r2 double")).collect()
    assert [r["algorithm"] for r in got] == ["forest", "ridge"]
    assert got[0]["r2_mean"] == pytest.approx(np.mean(seeds))
    assert got[0]["r2_std"] == pytest.approx(np.std(seeds))
    assert got[0]["r2_range"] == pytest.approx(max(seeds) - min(seeds))
    assert (got[1]["r2_std"], got[1]["n_seeds"]) == (0.0, 3)


def folds(spark, table):
    rows = [(a, f + 1, 1 - s, 2 - s, s) for a, scores in table.items() for f, s in enumerate(scores)]
    return spark.createDataFrame(rows, "algorithm string, fold int, mae double, rmse double, r2 double")


TABLE = {"ridge": [0.9, 0.8, 0.7, 0.85, 0.95], "tree": [0.7, 0.71, 0.73, 0.8, 0.92], "forest": [0.9, 0.8, 0.7, 0.85, 0.95]}


def test_lists_and_pivot(spark):
    df = folds(spark, TABLE)
    wide = {r["fold"]: (r["ridge"], r["tree"]) for r in pivot_scores(df, "r2", ["ridge", "tree"]).collect()}
    assert wide[2] == (0.8, 0.71)
    with pytest.raises(Exception, match="more than one score"):
        pivot_scores(df.unionByName(df), "r2", ["ridge"]).collect()
    lists = spark.createDataFrame(
        [("m", [1.0, 2.0], [3.0, 4.0], [0.5, 0.6])], "algorithm string, mae array<double>, rmse array<double>, r2 array<double>"
    )
    assert [tuple(r) for r in fold_lists_to_rows(lists).collect()] == [("m", 1, 1.0, 3.0, 0.5), ("m", 2, 2.0, 4.0, 0.6)]
    assert mean_scores(df).where("algorithm = 'ridge'").first()["r2"] == pytest.approx(0.84)


def test_pairs():
    assert score_pairs(["b", "a", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert score_pairs(["b", "a", "c"], "b") == [("b", "a"), ("b", "c")]
    with pytest.raises(ValueError, match="not found"):
        score_pairs(["a"], "z")


def test_tests_of_equal_models_are_undefined(spark):
    rows = {(r["model_b"], r["metric"]): r for r in significance_vs_baseline(folds(spark, TABLE), list(TABLE), "ridge").collect()}
    assert len(rows) == 6
    same = rows["forest", "r2"]
    assert same["t_p"] is None and same["w_p"] is None and same["significant_t"] is None
    assert same["higher_mean"] == "forest"  # a tie names the second
    assert rows["tree", "r2"]["higher_mean"] == "ridge"
    assert rows["tree", "rmse"]["higher_mean"] == "tree"  # the larger error


def test_t_test_of_constant_differences(spark):
    df = spark.createDataFrame([("g", float(i), float(i - 1)) for i in range(5)], "g string, a double, b double")
    row = paired_t_test(df, "a", "b", ["g"]).first()
    assert row["t_stat"] == math.inf and row["t_p"] == pytest.approx(0)


def test_t_test_by_hand(spark):
    d = np.array([0.1, 0.3, -0.2, 0.4, 0.25])
    df = spark.createDataFrame([("g", float(x), 0.0) for x in d], "g string, a double, b double")
    row = paired_t_test(df, "a", "b", ["g"]).first()
    t = d.mean() / (d.std(ddof=1) / math.sqrt(5))
    c2 = 4 / (4 + t * t)
    assert row["t_stat"] == pytest.approx(t)
    assert row["t_p"] == pytest.approx(1 - math.sqrt(1 - c2) * (1 + c2 / 2))


def signed_rank(spark, d, **more):
    df = spark.createDataFrame([("g", i, float(x), 0.0) for i, x in enumerate(d)], "g string, fold int, a double, b double")
    return wilcoxon_signed_rank(df, "a", "b", ["g"], **more).first()


@pytest.mark.parametrize("d, p", [([1, 2, 3, 4, 5], 0.0625), ([-1, 2, 3, 4, 5], 0.125), ([1, -2, 3, 4, 5], 0.1875), ([-1, -2, 3, 4, 5], 0.3125)])
def test_signed_rank_of_five(spark, d, p):
    assert signed_rank(spark, d)["w_p"] == pytest.approx(p)


def test_signed_rank_with_ties_and_zeros(spark):
    d = [1, -1, 2, 2, -3, 0, 0, 4]
    ranks = np.array([1.5, -1.5, 3.5, 3.5, -5, 6])
    w = min(ranks[ranks > 0].sum(), -ranks[ranks < 0].sum())
    n = 6
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - 2 * (2**3 - 2) / 48)
    z = (w - n * (n + 1) / 4) / sd
    for max_rows in (2, 1000):
        row = signed_rank(spark, d, max_rows=max_rows)
        assert (row["n_nonzero"], row["w_stat"]) == (6, w)
        assert row["w_p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert signed_rank(spark, [0, 0, 0])["w_p"] is None


def test_long_groups_are_close_to_the_exact_test(spark):
    d = np.random.default_rng(3).normal(0.2, 1, 50)
    exact = signed_rank(spark, d)["w_p"]
    more = signed_rank(spark, list(d) + [0.0001, -0.0002])["w_p"]
    assert exact == pytest.approx(more, abs=0.02)


def test_all_pairs_of_one_metric(spark):
    rows = paired_tests(folds(spark, TABLE), list(TABLE), metrics=["r2"]).collect()
    assert {(r["model_a"], r["model_b"]) for r in rows} == {("forest", "ridge"), ("forest", "tree"), ("ridge", "tree")}
    row = next(r for r in rows if (r["model_a"], r["model_b"]) == ("ridge", "tree"))
    d = np.array(TABLE["ridge"]) - np.array(TABLE["tree"])
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    null = [sum(r for r, s in zip(range(1, 6), signs) if s) for signs in product((0, 1), repeat=5)]
    assert row["w_p"] == pytest.approx(min(1, 2 * np.mean(np.array(null) <= w)))


def test_signed_rank_method(spark):
    rows = [(i, float(i), float(i) + (1 if i % 3 else -1) * (0.1 + i / 100)) for i in range(12)]
    df = spark.createDataFrame(rows, "fold int, a double, b double").withColumn("g", F.lit("x"))
    p = {m: wilcoxon_signed_rank(df, "a", "b", ["g"], method=m).first()["w_p"] for m in ("auto", "exact", "normal")}
    assert p["auto"] == p["exact"] != p["normal"]
    tied = df.withColumn("b", F.col("a") + 1)
    q = {m: wilcoxon_signed_rank(tied, "a", "b", ["g"], method=m).first()["w_p"] for m in ("auto", "exact", "normal")}
    assert q["exact"] == pytest.approx(2 / 2**12) and q["auto"] == q["normal"]


@pytest.mark.parametrize("seed", range(4))
def test_exact_signed_rank_with_ties(spark, seed):
    """All sign patterns listed, with ties and zeros, up to sixteen pairs."""
    r = random.Random(seed)
    groups = {g: [r.randrange(-4, 6) for _ in range(n)] for g, n in enumerate((3, 7, 11, 16))}
    df = spark.createDataFrame([(g, i, float(x)) for g, d in groups.items() for i, x in enumerate(d)], "g int, fold int, a double")
    got = {x["g"]: x for x in wilcoxon_signed_rank(df.withColumn("b", F.lit(0.0)), "a", "b", ["g"], method="exact").collect()}
    for g, d in groups.items():
        d = [x for x in d if x]
        sizes = sorted(abs(x) for x in d)
        ranks = [sizes.index(abs(x)) + (sizes.count(abs(x)) + 1) / 2 for x in d]
        w = min(sum(k for k, x in zip(ranks, d) if x > 0), sum(k for k, x in zip(ranks, d) if x < 0))
        low = sum(sum(k for i, k in enumerate(ranks) if s >> i & 1) <= w for s in range(2 ** len(d)))
        assert (got[g]["n_nonzero"], got[g]["w_stat"]) == (len(d), w)
        assert got[g]["w_p"] == pytest.approx(min(1, 2 * low / 2 ** len(d)))


def test_exact_signed_rank_of_more_pairs(spark):
    """With more pairs than asked for null; asked for, near the approximation."""
    r = random.Random(1)
    df = spark.createDataFrame([(0, i, float(r.randrange(-9, 14))) for i in range(70)], "g int, fold int, a double").withColumn("b", F.lit(0.0))
    assert wilcoxon_signed_rank(df, "a", "b", ["g"], method="exact").first()["w_p"] is None
    exact = wilcoxon_signed_rank(df, "a", "b", ["g"], method="exact", exact_pairs=100).first()["w_p"]
    assert exact == pytest.approx(wilcoxon_signed_rank(df, "a", "b", ["g"], method="normal").first()["w_p"], abs=0.01)
