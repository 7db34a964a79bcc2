import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolode.functions.distributions import normal_two_sided, signed_rank_exact, student_t_two_sided
from chronolode.functions.encoding import (
    Bands,
    Category,
    Quantiles,
    bucket_hours,
    cut_bands,
    cut_quantiles,
    discretize,
    flag_positive,
    one_hot,
    to_transactions,
)
from chronolode.functions.quantiles import grouped_quantiles, quantile_edges


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def numbered(spark, values, kind="double"):
    if kind == "double":
        values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


BANDS = ["Good", "Moderate", "Unhealthy", "VeryUnhealthy", "Hazardous"]


def test_bands_are_right_closed(spark):
    df = numbered(spark, [-0.1, -0.05, 0.0, 35.0, 35.01, 250.0, 1e9, None])
    cut = cut_bands(df, "x", [-0.1, 35, 75, 150, 250, float("inf")], BANDS, "b")
    assert column(cut, "b") == [None, "Good", "Good", "Good", "Moderate", "VeryUnhealthy", "Hazardous", None]


def test_quantile_bands_keep_ties_together(spark):
    cut = cut_quantiles(numbered(spark, [1.0, 2, 2, 2, 3, 4, 10]), {"x": "b"}, ["L", "M", "H"])
    assert column(cut, "b") == ["L", "L", "L", "L", "M", "H", "H"]


def test_equal_quantile_edges_are_an_error_or_merge(spark):
    df = numbered(spark, [0.0, 0, 0, 0, 0, 1, 2])
    with pytest.raises(ValueError, match="unique"):
        cut_quantiles(df, {"x": "b"}, ["L", "M", "H"])
    merged = cut_quantiles(df, {"x": "b"}, ["L", "M", "H"], on_duplicate="merge")
    assert column(merged, "b") == ["H"] * 7  # edges 0, 0, 0, 2: one band is left


def test_quantile_bands_of_nothing(spark):
    assert column(cut_quantiles(numbered(spark, [None, None]), {"x": "b"}), "b") == [None, None]


def test_one_hot_keeps_all_levels_and_nulls(spark):
    hot = one_hot(numbered(spark, ["b", None, "a"], "string"), "x", "w")
    assert hot.columns == ["i", "w_a", "w_b"]
    assert [tuple(r)[1:] for r in hot.orderBy("i").collect()] == [(0, 1), (0, 0), (1, 0)]
    with pytest.raises(ValueError):
        one_hot(numbered(spark, ["a", "b", "c"], "string"), "x", "w", max_levels=2)


def test_hour_buckets_and_flags(spark):
    hours = numbered(spark, [4, 5, 10, 11, 16, 17, 21, 22, None], "int").withColumn("b", bucket_hours(F.col("x")))
    assert column(hours, "b") == [
        "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night", "Night",
    ]
    flags = numbered(spark, [0.0, 0.5, None]).withColumn("b", flag_positive(F.col("x")))
    assert column(flags, "b") == ["No", "Yes", "No"]


def test_null_items_are_left_out(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, None, None)], "i int, x double, c string")
    rules = [Bands("X", "x", (0.0, 10.0), ("ok",)), Category("C", "c")]
    tx = to_transactions(discretize(df, rules, ["i"]), ["X", "C"], "i")
    assert column(tx, "items") == [["C=a", "X=ok"], ["C=b"], []]


def test_quantile_rules_share_edges(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(9)], "i int, x double, y double")
    cut = discretize(df, [Quantiles("X", "x"), Quantiles("Y", "y")], ["i"])
    assert column(cut, "X")[0] == "X=Low" and column(cut, "Y")[0] == "Y=High"


PROBS = [0.0, 1 / 3, 0.5, 0.995, 1.0]


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(1).normal(size=4000),
        np.random.default_rng(2).lognormal(0, 5, size=4000),
        np.random.default_rng(3).integers(0, 7, size=4000).astype(float),
        np.concatenate([np.zeros(3000), np.random.default_rng(4).normal(size=1000)]),
        np.concatenate([np.linspace(0, 1e-9, 2000), [1e300, -1e300]]),
    ],
    ids=["normal", "heavy-tail", "few-values", "one-hot-value", "extreme"],
)
@pytest.mark.parametrize("max_rows", [10, 300, 1_000_000])
def test_quantiles_equal_numpy_on_every_path(spark, values, max_rows):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    found = quantile_edges(df, ["x"], PROBS, max_rows)["x"]
    assert np.allclose(found, np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_quantiles_by_group_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=3000), "b": rng.normal(size=40), "c": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: r for r in grouped_quantiles(df, "k", "x", PROBS, max_rows=500).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        assert found[k]["n"] == len(vs)
        assert np.allclose(found[k]["q"], np.quantile(vs, PROBS), rtol=1e-12)


def test_t_of_the_tables(spark):
    # Two-sided 5 % points by degrees of freedom.
    points = {1: 12.7062047, 2: 4.30265273, 3: 3.18244631, 4: 2.77644511, 5: 2.57058184, 10: 2.22813885, 30: 2.04227246}
    df = spark.createDataFrame(list(points.items()), "df int, t double")
    for r in df.select(student_t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-8)
    odd = spark.createDataFrame([(4, float("nan")), (4, None), (0, 1.0)], "df int, t double")
    assert [r["p"] for r in odd.select(student_t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()] == [None] * 3


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.0, 1.959963985, 3.0, 3.6, 6.0, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-9)


@settings(max_examples=12, deadline=None)
@given(n=st.integers(1, 11))
def test_signed_rank_counts_equal_enumeration(spark, n):
    sums = np.zeros(1)
    for rank in range(1, n + 1):
        sums = np.concatenate([sums, sums + rank])
    ws = list(range(n * (n + 1) // 4 + 1))
    df = spark.createDataFrame([(n, float(w)) for w in ws], "n int, w double")
    got = [r["p"] for r in df.orderBy("w").select(signed_rank_exact(F.col("w"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([min(1.0, 2 * np.mean(sums <= w)) for w in ws])


@pytest.mark.parametrize("odd", [[], [float("inf")], [float("-inf"), float("inf")], [float("nan")] * 3, [float("-inf")] * 40, [1e308, -1e308]])
def test_quantiles_do_not_depend_on_size(spark, odd):
    values = [float(i % 37) for i in range(300)] + odd
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    a, b = (quantile_edges(df, ["x"], probs, max_rows=m)["x"] for m in (10, 10**6))
    assert [repr(v) for v in a] == [repr(v) for v in b]


def test_grouped_quantiles_of_many_large_groups(spark):
    rows = [(f"g{i % 60}", float((i * 7919) % 1009)) for i in range(6000)] + [(None, 1.0), ("g0", None), ("small", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {m: {r["g"]: (r["n"], r["q"]) for r in grouped_quantiles(df, "g", "x", [0.25, 0.5], max_rows=m).collect()} for m in (10, 10**6)}
    assert got[10] == got[10**6] and len(got[10]) == 61
