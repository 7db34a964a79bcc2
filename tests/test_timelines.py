import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolode.operators.features import FeatureSpec, build_features, horizon_features, with_levels
from chronolode.operators.ordering import (
    TimeOrder,
    expanding_folds,
    fold_starts,
    head_by_time,
    holdout_split,
    order_by_time,
    prepare_series,
    with_position,
)
from chronolode.operators.series import (
    add_lags,
    add_rolling_mean,
    complete_rows,
    interpolate_linear,
    shift_target,
)

ORDER = TimeOrder("t")
KEYED = TimeOrder("t", ties=("id",), keys=("k",))


def values(df, col="x", by="t"):
    return [r[col] for r in df.orderBy(by).collect()]


def line(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "t int, x double")


@pytest.mark.parametrize(
    "xs, want",
    [
        ([None, None, 3.0, None, None, 9.0, None], [3, 3, 3, 5, 7, 9, 9]),
        ([None, None], [None, None]),
        ([None, 4.0, None], [4, 4, 4]),
        ([1.0], [1]),
    ],
)
@pytest.mark.parametrize("max_rows", [1, 2, 3, 100])
def test_gap_fill(spark, xs, want, max_rows):
    df, order = prepare_series(line(spark, xs), ORDER, max_rows)
    assert values(interpolate_linear(df, "x", order)) == want


def test_forward_fill_uses_nothing_later(spark):
    for max_rows in (2, 100):
        df, order = prepare_series(line(spark, [None, 1.0, None, 5.0, None]), ORDER, max_rows)
        assert values(interpolate_linear(df, "x", order, method="ffill")) == [None, 1, 1, 5, 5]


def test_rolling_mean_needs_all_earlier_rows(spark):
    df = line(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert values(add_rolling_mean(df, "x", [2], ORDER), "roll_mean_2") == [None, None, 1.5, None, None, 4.5]


def random_events(spark, n=3000, seed=7):
    """A hot series with half of all rows, a few middle ones, many short ones."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    k = np.where(k < 30, k, rng.integers(30, 300, n))
    x = np.where(rng.random(n) < 0.6, np.nan, rng.normal(size=n).round(3))
    x[(k % 5) == 2] = np.nan  # whole series without a value
    pdf = pd.DataFrame({"k": k, "t": rng.integers(0, 500, n), "id": np.arange(n), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf.sort_values(["k", "t", "id"]).reset_index(drop=True), df


def expected(pdf):
    def one(g):
        filled = g["x"].interpolate(method="linear", limit_direction="both")
        return g.assign(
            x=filled,
            lag_1=filled.shift(1),
            lag_2=filled.shift(2),
            roll_mean_6=filled.shift(1).rolling(6).mean(),
            roll_mean_24=filled.shift(1).rolling(24).mean(),
            pos=np.arange(len(g)),
        )

    return pd.concat([one(g) for _, g in pdf.groupby("k")]).sort_values("id").reset_index(drop=True)


def as_pandas(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("max_rows", [25, 60, 400, 10_000])
def test_blocks_equal_whole_series(spark, max_rows):
    pdf, df = random_events(spark)
    want = expected(pdf)
    prepared, order = prepare_series(df, KEYED, max_rows)
    assert (order.block_rows is not None) == (max_rows < 1000)
    got = interpolate_linear(prepared, "x", order)
    got = as_pandas(add_rolling_mean(add_lags(got, "x", [1, 2], order), "x", [6, 24], order))
    for c in ("x", "lag_1", "lag_2", "roll_mean_6", "roll_mean_24"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=1e-9)
    placed = as_pandas(with_position(df, KEYED, max_series_rows=max_rows))
    assert (placed["pos"] == want["pos"]).all()


@pytest.mark.parametrize("max_rows", [25, 60, 10_000])
@pytest.mark.parametrize("horizon", [0, 6, 24])
def test_features_equal_the_step_by_step_build(spark, max_rows, horizon):
    pdf, df = random_events(spark, 1500, seed=horizon)
    want = expected(pdf)
    want["label"] = want.sort_values(["k", "pos"]).groupby("k")["x"].shift(-horizon)
    cols = ["lag_1", "lag_2", "roll_mean_6", "roll_mean_24", "label"]
    want = want.dropna(subset=cols).reset_index(drop=True)
    prepared, order = prepare_series(df, KEYED, max_rows)
    got = as_pandas(build_features(prepared, FeatureSpec("x", calendar=False), order, horizon))
    assert list(got["id"]) == list(want["id"])
    np.testing.assert_allclose(got[cols].to_numpy(float), want[cols].to_numpy(float), rtol=0, atol=1e-9)


def test_horizons_equal_single_builds(spark):
    _, df = random_events(spark, 1500)
    prepared, order = prepare_series(df, KEYED, 80)
    spec = FeatureSpec("x", calendar=False)
    stacked = horizon_features(prepared, spec, order, [0, 6])
    for h in (0, 6):
        one = build_features(prepared, spec, order, h)
        both = stacked.where(F.col("horizon") == h).drop("horizon").select(one.columns)
        assert both.exceptAll(one).isEmpty() and one.exceptAll(both).isEmpty()


def test_target_shift_on_blocks(spark):
    xs = [float(i * i) for i in range(50)]
    for max_rows in (7, 100):
        df, order = prepare_series(line(spark, xs), ORDER, max_rows)
        assert values(shift_target(df, "x", 5, order)) == xs[5:] + [None] * 5


def test_rows_without_time_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0)], "t int, x double")
    with pytest.raises(Exception, match="null in t"):
        with_position(df, ORDER).collect()


def test_fold_starts():
    assert fold_starts(101, 5) == ([21, 37, 53, 69, 85], 16)
    with pytest.raises(ValueError):
        fold_starts(5, 5)


def test_folds_train_on_earlier_rows_only(spark):
    df = spark.range(101).withColumnRenamed("id", "pos")
    rows = expanding_folds(df, 5).collect()
    for f in range(1, 6):
        train = {r["pos"] for r in rows if r["fold"] == f and r["role"] == "train"}
        held = {r["pos"] for r in rows if r["fold"] == f and r["role"] == "validation"}
        start = fold_starts(101, 5)[0][f - 1]
        assert train == set(range(start)) and held == set(range(start, start + 16))


def test_holdout_and_head(spark):
    df = spark.range(11).withColumnRenamed("id", "pos")
    split = {r["pos"]: r["split"] for r in holdout_split(df, 0.2).collect()}
    assert [split[i] for i in range(11)] == ["train"] * 8 + ["test"] * 3
    assert [r["pos"] for r in head_by_time(df, 3).collect()] == [0, 1, 2]
    assert [r["pos"] for r in order_by_time(df, TimeOrder("pos")).collect()] == list(range(11))


def test_complete_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert complete_rows(df).count() == 1
    assert complete_rows(df, ["a"]).count() == 2


def test_null_ties_and_category_keys_lose_no_rows(spark):
    rows = [(f"k{i % 2}", i, None if i % 3 else i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "kind string, t long, tie long, x double").withColumn("ts", F.timestamp_seconds("t"))
    order = TimeOrder("ts", ties=("tie",), keys=("kind",))
    spec = FeatureSpec("x", category="kind", lags=(1,), windows=(2,), calendar=False)
    out = build_features(df, spec, order)
    assert out.count() == 40 - 2 * 2
    assert {"kind", "cat_k0", "cat_k1"} <= set(out.columns)
    assert out.where((F.col("kind") == "k0") & (F.col("cat_k0") != 1)).isEmpty()


def test_category_levels_can_be_raised(spark):
    df = spark.range(1200).select(F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError):
        with_levels(df, FeatureSpec("x", category="c"))
    assert len(with_levels(df, FeatureSpec("x", category="c", max_levels=1200)).levels) == 1200


def test_windows_longer_than_a_block(spark):
    df = spark.range(300).select(F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"))
    spec = FeatureSpec("x", lags=(1, 40), windows=(60,), calendar=False)
    found = []
    for most in (10**6, 25):
        placed, order = prepare_series(df, TimeOrder("ts"), most)
        rows = build_features(placed, spec, order, horizon=30).select("ts", "lag_40", "roll_mean_60", "label").collect()
        found.append(sorted((r[0], r[1], round(r[2], 9), r[3]) for r in rows))
    assert found[0] == found[1] and found[0]
