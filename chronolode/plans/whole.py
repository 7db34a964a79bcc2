"""Catalog: the whole run, from the profile to the rules, on the hourly series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.encoding import Bands, Category, HourOfDay, Positive, Quantiles
from chronolode.operators.models import boosted, forest, ridge, tree
from chronolode.operators.profile import ProfileSpec
from chronolode.operators.tuning import RIDGE_GRID, Search
from chronolode.plans.analysis import Analysis, analyse
from chronolode.plans.inputs import HOURLY_ORDER, HOURLY_SPEC, hourly
from chronolode.plans.registry import query

_EDGES = (-1.0, 20.0, 60.0, 150.0, float("inf"))
_LABELS = ("Good", "Moderate", "Bad", "Hazardous")

#: Trees are fewer and shallower than published, as COVERAGE.md says.
WHOLE = Analysis(
    order=HOURLY_ORDER,
    features=HOURLY_SPEC,
    profile=ProfileSpec("ts", "y", ("x1", "x2", "x3"), "cat", _EDGES, _LABELS),
    items=[
        Bands("Y", "y", _EDGES, _LABELS),
        Category("CAT", "cat"),
        Quantiles("X1", "x1"),
        HourOfDay("TIME", "hour"),
        Positive("F2", "f2"),
    ],
    target_prefix="Y=",
    rare_targets=["Y=Bad", "Y=Hazardous"],
    models=[ridge(), tree(max_depth=6), forest(trees=5, max_depth=5), boosted(rounds=3, max_depth=3)],
    searches=[Search(ridge(), RIDGE_GRID), Search(tree(), {"max_depth": [4, 6]}, folds=2)],
    folds=2,
    horizons=(0, 24),
    seeds=(0,),
    sample=500,
    parallelism=8,
)


@query()
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result table of one run, by its name and rows."""
    raw = hourly(spark, sf_dir).withColumn("hour", F.hour("ts"))
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, t in analyse(raw, WHOLE).items()]
    return reduce(DataFrame.unionByName, counts)
