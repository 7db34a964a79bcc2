"""The whole feature build, and its repetition over forecast horizons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.calendar import add_calendar, cyclical
from chronolode.functions.encoding import MAX_LEVELS, category_levels, one_hot
from chronolode.operators.ordering import TimeOrder, block_window, drop_copies, over_series, spread_blocks, with_reach
from chronolode.operators.series import (
    complete_rows,
    fill_blocks,
    interpolate_linear,
    lag_of,
    lead_of,
    rolling_mean_of,
)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns become features. ``label`` is gap-filled first; its lags and
    rolling means come from the filled values and see earlier rows only. The
    other columns are used as of the row itself. A category of more than
    ``max_levels`` levels is an error, as each becomes a column."""

    label: str
    numeric: tuple[str, ...] = ()
    category: str | None = None
    category_prefix: str = "cat"
    levels: tuple[str, ...] | None = None
    max_levels: int = MAX_LEVELS
    lags: tuple[int, ...] = (1, 2)
    windows: tuple[int, ...] = (6, 24)
    calendar: bool = True
    fill: str = "linear"

    @property
    def columns(self) -> list[str]:
        """Feature names in output order; needs the levels of the category."""
        names = list(self.numeric)
        if self.category:
            if self.levels is None:
                raise ValueError("levels are not known yet, see with_levels")
            names += [f"{self.category_prefix}_{v}" for v in sorted(self.levels)]
        if self.calendar:
            names += [f"{part}_{f}" for part in ("hour", "dow", "month") for f in ("sin", "cos")]
        return names + [f"lag_{k}" for k in self.lags] + [f"roll_mean_{w}" for w in self.windows]


# Steps per turn of each calendar circle.
CALENDAR_PERIODS = {"hour": 24, "dow": 7, "month": 12}


def with_levels(df: DataFrame, spec: FeatureSpec) -> FeatureSpec:
    """Fix the category levels, so that the output columns are known."""
    if spec.category is None or spec.levels is not None:
        return spec
    return replace(spec, levels=tuple(category_levels(df, spec.category, spec.max_levels)))


def _feature_columns(
    df: DataFrame, spec: FeatureSpec, order: TimeOrder, horizons: Sequence[int]
) -> tuple[DataFrame, FeatureSpec]:
    """Everything but the choice of target: features plus one ``__y<h>`` column
    per horizon, all windows of one direction in one sort."""
    spec = with_levels(df, spec)
    needed = {spec.label, *spec.numeric, *([spec.category] if spec.category else []), *order.all_cols}
    if order.pos:
        needed.add(order.pos)
    kept = df.select(*[c for c in df.columns if c in needed])
    exprs = {f"lag_{k}": lag_of(spec.label, k) for k in spec.lags}
    exprs |= {f"roll_mean_{w}": rolling_mean_of(spec.label, w) for w in spec.windows}
    exprs |= {f"__y{h}": lead_of(spec.label, h) for h in horizons}
    back, ahead = max([0, *spec.lags, *spec.windows]), max([0, *horizons])
    if order.block_rows is None:
        wide = over_series(interpolate_linear(kept, spec.label, order, method=spec.fill), order, exprs)
    else:
        # fill and windows on the same blocks: the rows are shuffled once
        order = with_reach(order, back, ahead)
        spread = spread_blocks(kept, order, back, ahead)
        filled = fill_blocks(spread, kept, spec.label, order, spec.label, spec.fill, back, ahead)
        w = block_window(order)
        wide = drop_copies(filled.select("*", *[f(w).alias(name) for name, f in exprs.items()]))
    if spec.category:  # the column itself stays, as it may be a key too
        wide = one_hot(wide.withColumn("__category", F.col(spec.category)), "__category", spec.category_prefix, spec.levels)
    if spec.calendar:
        wide = add_calendar(wide, order.ts, "__hour", "__dow", "__month")
        circles = {}
        for part, period in CALENDAR_PERIODS.items():
            circles[f"{part}_sin"], circles[f"{part}_cos"] = cyclical(F.col(f"__{part}"), period)
        wide = wide.withColumns(circles)
    return wide, spec


def build_features(df: DataFrame, spec: FeatureSpec, order: TimeOrder, horizon: int = 0) -> DataFrame:
    """Gap fill, encoding, calendar, lags, rolling means and target in one plan.
    Returns the order columns, the features of ``spec.columns`` and ``label``;
    rows with a null feature or label (the first rows of a series, the last
    ``horizon``) go; a null among the ties does not matter.

    The target of a row lies ``horizon`` rows after it, and ``lag_1`` is the row
    before it, so ``horizon`` counts extra rows ahead of a one-step forecast."""
    wide, spec = _feature_columns(df, spec, order, [horizon])
    kept = wide.select(*order.all_cols, *spec.columns, F.col(f"__y{horizon}").alias("label"))
    return complete_rows(kept, [*spec.columns, "label"])


def horizon_features(df: DataFrame, spec: FeatureSpec, order: TimeOrder, horizons: Sequence[int]) -> DataFrame:
    """``build_features`` for several horizons stacked under ``horizon``. The
    features are computed once; only the target differs."""
    wide, spec = _feature_columns(df, spec, order, horizons)
    targets = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__y{h}").alias("label")) for h in horizons])
    kept = complete_rows(wide.select(*order.all_cols, *spec.columns, targets.alias("__t")), spec.columns)
    stacked = kept.select(*order.all_cols, *spec.columns, F.explode("__t").alias("__target"))
    return complete_rows(
        stacked.select(F.col("__target.horizon"), *order.all_cols, *spec.columns, F.col("__target.label")), ["label"]
    )
