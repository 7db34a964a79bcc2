"""The whole analysis on a small hourly series written as CSV."""

import math

import numpy as np

from chronolode.functions.encoding import SEASONS, Bands, Category, HourOfDay, Mapped, Positive, Quantiles
from chronolode.operators.features import FeatureSpec
from chronolode.operators.models import boosted, forest, ridge, tree
from chronolode.operators.ordering import TimeOrder
from chronolode.operators.profile import ProfileSpec
from chronolode.operators.tuning import Integers, Search
from chronolode.plans.analysis import Analysis, analyse, write_analysis
from chronolode.sources.observations import read_observations, with_timestamp

EDGES = (-0.1, 35.0, 75.0, 150.0, 250.0, float("inf"))
LABELS = ("Good", "Moderate", "Unhealthy", "VeryUnhealthy", "Hazardous")
SCHEMA = "no int, year int, month int, day int, hour int, pm25 double, temp double, wind string, rain double"


def write_csv(path, days=40):
    rng = np.random.default_rng(8)
    lines, level = ["No,year,month,day,hour,pm2.5,TEMP,cbwd,Ir"], 80.0
    for i in range(days * 24):
        day, hour = divmod(i, 24)
        month, dom = 1 + day // 28, 1 + day % 28
        wind = str(rng.choice(["NE", "NW", "SE", "cv"]))
        level = max(1.0, level * 0.95 + rng.normal(4, 12) - (8 if wind == "NW" else 0))
        pm = "NA" if i < 5 or rng.random() < 0.05 else f"{level:.1f}"
        temp = 5 * math.sin(hour / 24 * 2 * math.pi) + rng.normal()
        lines.append(f"{i + 1},2010,{month},{dom},{hour},{pm},{temp:.2f},{wind},{int(rng.random() < 0.05)}")
    path.write_text("\n".join(lines) + "\n")


def test_whole_analysis(spark, tmp_path):
    write_csv(tmp_path / "observations.csv")
    raw = read_observations(spark, str(tmp_path / "observations.csv"), SCHEMA)
    raw = with_timestamp(raw, {c: c for c in ("year", "month", "day", "hour")})
    plan = Analysis(
        order=TimeOrder("ts"),
        features=FeatureSpec("pm25", numeric=("temp", "rain"), category="wind", category_prefix="wind"),
        profile=ProfileSpec("ts", "pm25", ("temp", "rain"), "wind", EDGES, LABELS),
        items=[
            Bands("PM25", "pm25", EDGES, LABELS),
            Category("WIND", "wind"),
            Quantiles("TEMP", "temp"),
            Mapped("SEASON", "month", SEASONS),
            HourOfDay("TIME", "hour"),
            Positive("RAIN", "rain"),
        ],
        target_prefix="PM25=",
        rare_targets=["PM25=VeryUnhealthy", "PM25=Unhealthy"],
        models=[ridge(), tree(max_depth=3), forest(trees=3, max_depth=3), boosted(rounds=3, max_depth=2)],
        searches=[Search(ridge(), {"alpha": [0.1, 100.0]}, folds=2), Search(boosted(), {"rounds": Integers(2, 4), "max_depth": [2]}, folds=2, draws=1)],
        folds=2,
        horizons=(0, 24),
        seeds=(0, 1),
        sample=100,
    )
    found = analyse(raw, plan)
    counts = {name: t.count() for name, t in found.items()}
    assert counts["profile_series"] == 960 and counts["profile_by_month"] == 12
    assert counts["cv_summary"] == 4 and counts["cv_fold_scores"] == 8 and counts["horizon_scores"] == 8
    assert counts["significance"] == 9
    assert counts["untuned_and_tuned"] == 6 and counts["best_parameters"] == 2
    assert counts["seed_scores"] == 8 and counts["seed_summary"] == 4
    n = 960 - 24
    assert found["feature_table"].first()["n_rows"] == n
    assert counts["actual_and_predicted"] == n - int(n * 0.8)
    assert found["attribution"].first()["feature"] == "lag_1"
    assert counts["rules_common"] > 0
    assert found["rules_common"].where("consequent not like 'PM25=%'").isEmpty()
    assert found["rules_rare"].where("consequent not in ('PM25=VeryUnhealthy', 'PM25=Unhealthy')").isEmpty()
    write_analysis({k: found[k] for k in ("best_parameters", "significance")}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "significance")).count() == 9
