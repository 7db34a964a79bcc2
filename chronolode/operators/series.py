"""Gap filling, lags, rolling means and forecast targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.operators.ordering import (
    TimeOrder,
    block_of,
    block_window,
    drop_copies,
    over_series,
    spread_blocks,
)
from chronolode.sources.scratch import materialise


def lag_of(col: str, k: int):
    return lambda w: F.lag(col, k).over(w)


def lead_of(col: str, k: int):
    return lambda w: F.lead(col, k).over(w) if k else F.col(col)


def rolling_mean_of(col: str, size: int):
    """Mean of the ``size`` rows before this one, null unless all are present."""

    def mean(w) -> Column:
        frame = w.rowsBetween(-size, -1)
        return F.when(F.count(col).over(frame) == size, F.avg(col).over(frame))

    return mean


def add_lags(df: DataFrame, col: str, ks: Sequence[int], order: TimeOrder, prefix: str = "lag_") -> DataFrame:
    """Add the value of ``col`` ``k`` rows back for each k."""
    return over_series(df, order, {f"{prefix}{k}": lag_of(col, k) for k in ks}, back=max(ks))


def add_rolling_mean(
    df: DataFrame, col: str, windows: Sequence[int], order: TimeOrder, prefix: str = "roll_mean_"
) -> DataFrame:
    """Add the mean of the previous w rows for each w; this row is not in it."""
    return over_series(df, order, {f"{prefix}{w}": rolling_mean_of(col, w) for w in windows}, back=max(windows))


def shift_target(df: DataFrame, col: str, horizon: int, order: TimeOrder) -> DataFrame:
    """Replace ``col`` by its value ``horizon`` rows ahead. Lags and rolling means
    must be built before, from the unshifted column."""
    if horizon == 0:
        return df
    return over_series(df, order, {col: lead_of(col, horizon)}, ahead=horizon)


def _fill(col: str, before: Column, behind: Column, after: Column, ahead: Column, method: str) -> Column:
    """Value at a row ``behind`` rows after its left neighbour and ``ahead`` rows
    in front of its right one."""
    value = F.col(col).cast("double")
    if method == "ffill":
        return F.coalesce(value, before["v"])
    slope = (after["v"] - before["v"]) / (behind + ahead)
    return (
        F.when(F.col(col).isNotNull(), value)
        .when(before.isNull(), after["v"])
        .when(after.isNull(), before["v"])
        .otherwise(before["v"] + behind * slope)
    )


def _point(col: str, place: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.struct(F.col(place).alias("p"), F.col(col).cast("double").alias("v")))


def interpolate_linear(
    df: DataFrame, col: str, order: TimeOrder, out: str | None = None, method: str = "linear"
) -> DataFrame:
    """Fill gaps by row position between the two neighbouring values; a leading
    gap takes the first value and a trailing gap the last. ``method='ffill'``
    takes the last earlier value instead and uses nothing from the future."""
    if method not in ("linear", "ffill"):
        raise ValueError(f"unknown method {method!r}")
    out = out or col
    names = list(df.columns) if out in df.columns else [*df.columns, out]
    if order.block_rows is not None:
        spread = fill_blocks(spread_blocks(df, order), df, col, order, out, method)
        return drop_copies(spread).select(*names)
    up, down = order.window(), order.window(descending=True)
    upto = (Window.unboundedPreceding, Window.currentRow)
    # The neighbour ahead is the last one seen in descending order: a running
    # frame costs one step per row, a frame to the end of the series does not.
    # Descending first, so that lags of the filled column reuse the last sort.
    placed = df.withColumn("__q", F.row_number().over(down))
    placed = placed.withColumn("__after", F.last(_point(col, "__q"), True).over(down.rowsBetween(*upto)))
    placed = placed.withColumn("__p", F.row_number().over(up))
    placed = placed.withColumn("__before", F.last(_point(col, "__p"), True).over(up.rowsBetween(*upto)))
    before, after = F.col("__before"), F.col("__after")
    fill = _fill(col, before, F.col("__p") - before["p"], after, F.col("__q") - after["p"], method)
    return placed.withColumn(out, fill).select(*names)


def _carried(df: DataFrame, col: str, order: TimeOrder, back: int, ahead: int) -> DataFrame:
    """For each block: the nearest value before its first row and beyond its last
    one, copied rows included. A table with one row per block, out of one
    aggregate over the rows that is combined before the shuffle."""
    keys = list(order.keys)
    at = F.when(F.col(col).isNotNull(), F.col(order.pos))
    # Moved by its reach, a group ends where the copied rows of a block begin.
    blocks = F.array(
        *[F.struct(F.lit(forward).alias("forward"), block_of(order, reach).alias("__block")) for forward, reach in ((True, back), (False, -ahead))]
    )
    rows = df.select(*keys, at.alias("at"), F.col(col).cast("double").alias("value"), F.explode(blocks).alias("b"))
    # plain numbers as aggregate buffers, so that rows are hashed and not sorted
    ends = materialise(
        rows.groupBy(*keys, "b.forward", "b.__block").agg(
            F.max("at").alias("last"), F.max_by("value", "at").alias("last_value"),
            F.min("at").alias("first"), F.min_by("value", "at").alias("first_value"),
        ),
        "block-ends",
    )

    def side(forward: bool) -> DataFrame:
        p, v = ("last", "last_value") if forward else ("first", "first_value")
        along = F.col("__block").asc() if forward else F.col("__block").desc()
        others = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        end = F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("p"), F.col(v).alias("v")))
        name = "__from_before" if forward else "__from_after"
        own = ends.where("forward" if forward else "NOT forward")
        return own.select(*keys, "__block", F.last(end, True).over(others).alias(name))

    return side(True).join(side(False), [*keys, "__block"], "full")


def fill_blocks(
    spread: DataFrame, df: DataFrame, col: str, order: TimeOrder, out: str, method: str, back: int = 0, ahead: int = 0
) -> DataFrame:
    """Fill gaps in the blocks of ``spread``, which came from ``df`` with the same
    ``back`` and ``ahead``. Neighbours inside a block come from windows, those
    beyond it from ``_carried``. The windows partition by the join keys, so the
    rows are shuffled once."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    up, down = block_window(order), block_window(order, descending=True)
    point = _point(col, order.pos)
    on = [*order.keys, "__block"]
    joined = (
        spread.withColumn("__after", F.last(point, True).over(down.rowsBetween(*upto)))
        .withColumn("__before", F.last(point, True).over(up.rowsBetween(*upto)))
        .join(_carried(df, col, order, back, ahead), on, "left")
    )
    before = F.coalesce("__before", "__from_before")
    after = F.coalesce("__after", "__from_after")
    near = joined.withColumns({"__before": before, "__after": after})
    before, after = F.col("__before"), F.col("__after")
    pos = F.col(order.pos)
    filled = near.withColumn(out, _fill(col, before, pos - before["p"], after, after["p"] - pos, method))
    return filled.drop("__before", "__after", "__from_before", "__from_after")


def series(df: DataFrame, ts: str, col: str) -> DataFrame:
    """Time and value of one column."""
    return df.select(ts, col)


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in any of ``subset``."""
    return df.dropna(how="any", subset=list(subset) if subset else None)
