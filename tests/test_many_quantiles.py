import random

import numpy as np
import pytest

from chronolode.functions import quantiles
from chronolode.functions.quantiles import quantile_edges


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    held = [(r.gauss(0, 1), float(r.randrange(12)), r.choice([None, float("nan"), float("-inf"), float("inf"), r.random(), 0.5])) for _ in range(4000)]
    return spark.createDataFrame(held, "a double, b double, c double").repartition(5), held


@pytest.mark.parametrize("count", [16, 17, 256])
def test_many_quantiles_of_large_columns_are_exact(rows, monkeypatch, count):
    df, held = rows
    probs = [i / count for i in range(1, count + 1)]
    want = quantile_edges(df, ["a", "b", "c"], probs)  # the plain way
    assert want["a"] == pytest.approx(np.quantile([x[0] for x in held], probs))
    # few rows, so that this margin leaves gaps between brackets and more brackets that overlap
    for margin in (0.003, 0.0005):
        monkeypatch.setattr(quantiles, "_MARGIN", margin)
        found = quantile_edges(df, ["a", "b", "c"], probs, max_rows=100)
        for c, values in want.items():
            assert found[c] == pytest.approx(values)


def test_brackets_are_searched_as_they_are_compared(spark, monkeypatch):
    r = random.Random(6)
    ends = sorted(float(r.randrange(60)) for _ in range(20))
    groups = spark.createDataFrame([(0, ends, [e + r.randrange(3) for e in ends])], "g int, `from` array<double>, `to` array<double>")
    rows = spark.createDataFrame([(0, x / 2) for x in range(-4, 140)], "g int, v double")
    both = []
    for most in (16, 99):
        monkeypatch.setattr(quantiles, "_COMPARED", most)
        both.append(sorted(quantiles._bracketed(rows, groups, 20).collect(), key=lambda x: (x["cell"], x["lo"])))
    assert both[0] == both[1] and len(both[0]) > 40


def test_probabilities_need_no_order(rows):
    df, _ = rows
    probs = [(7 * i % 31 + 1) / 32 for i in range(31)]
    found = quantile_edges(df, ["a"], probs, max_rows=100)["a"]
    assert found == pytest.approx(quantile_edges(df, ["a"], probs)["a"])


def test_the_plan_does_not_grow_with_the_quantiles(spark):
    rows = spark.createDataFrame([(0, 1.0)], "g int, v double")
    groups = spark.createDataFrame([(0, [1.0], [2.0])], "g int, `from` array<double>, `to` array<double>")
    sizes = [len(quantiles._bracketed(rows, groups, n)._jdf.queryExecution().analyzed().toString()) for n in (32, 256)]
    assert sizes[1] < 1.5 * sizes[0]
