"""Catalog: positions, splits, folds, gap filling, lags, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolode.functions.calendar import add_calendar, add_cyclical
from chronolode.operators.features import build_features, horizon_features
from chronolode.operators.ordering import (
    TimeOrder,
    expanding_folds,
    head_by_time,
    holdout_split,
    prepare_series,
    with_position,
)
from chronolode.operators.series import add_lags, add_rolling_mean, interpolate_linear, shift_target
from chronolode.plans.inputs import (
    HOURLY,
    HOURLY_ORDER,
    HOURLY_SPEC,
    KIND_ORDER,
    LONG_ORDER,
    ORDERS_ORDER,
    PAIR_SPEC,
    USER_ORDER,
    USER_SPEC,
    filled_sql,
    hourly,
    pair_features_sql,
    some_blocks,
    user_events,
)
from chronolode.plans.registry import query, steady, steady_sql
from chronolode.sources.tables import load


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TimeOrder]:
    return prepare_series(user_events(spark, sf_dir), USER_ORDER)


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TimeOrder]:
    """All events as one series, cut in blocks."""
    ev = user_events(spark, sf_dir)
    return prepare_series(ev, LONG_ORDER, some_blocks(ev.count()))


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TimeOrder]:
    """One series per event type: few, and too long for one task each."""
    ev = user_events(spark, sf_dir)
    return prepare_series(ev, KIND_ORDER, some_blocks(ev.count()) // 8)


_FILLED = f"select event_id, {steady_sql('yf')} as y from filled"


@query(f"with {filled_sql()} {_FILLED}")
def interpolate_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _users(spark, sf_dir)
    return steady(interpolate_linear(df, "y", order).select("event_id", "y"), "y")


@query(f"with {filled_sql('')} {_FILLED}")
def interpolate_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _long(spark, sf_dir)
    return steady(interpolate_linear(df, "y", order).select("event_id", "y"), "y")


@query(f"with {filled_sql('partition by event_type')} {_FILLED}")
def interpolate_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _kinds(spark, sf_dir)
    return steady(interpolate_linear(df, "y", order).select("event_id", "y"), "y")


@query(f"with {filled_sql(fill='ffill')} {_FILLED}")
def forward_fill_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _users(spark, sf_dir)
    return steady(interpolate_linear(df, "y", order, method="ffill").select("event_id", "y"), "y")


def _lags_sql(series: str) -> str:
    return (
        f"select event_id, lag(value, 1) over w as lag_1, lag(value, 2) over w as lag_2 from events "
        f"window w as ({series} order by ts, event_id)"
    )


@query(_lags_sql("partition by user_id"))
def lags_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), USER_ORDER)
    return add_lags(df, "value", [1, 2], order).select("event_id", "lag_1", "lag_2")


@query(_lags_sql(""))
def lags_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("ts", "event_id", "value")
    df, order = prepare_series(ev, LONG_ORDER, some_blocks(ev.count()))
    return add_lags(df, "value", [1, 2], order).select("event_id", "lag_1", "lag_2")


def _rolls_sql(series: str) -> str:
    def mean(w: int) -> str:
        frame = f"(w rows between {w} preceding and 1 preceding)"
        return f"case when count(y) over {frame} = {w} then {steady_sql(f"avg(y) over {frame}")} end as roll_mean_{w}"

    return (
        f"select event_id, {mean(6)}, {mean(24)} from "
        "(select *, value as y from events) "
        f"window w as ({series} order by ts, event_id)"
    )


@query(_rolls_sql("partition by user_id"))
def rolling_means_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), USER_ORDER)
    rolled = add_rolling_mean(df, "value", [6, 24], order).select("event_id", "roll_mean_6", "roll_mean_24")
    return steady(rolled, "roll_mean_6", "roll_mean_24")


@query(_rolls_sql("partition by event_type"))
def rolling_means_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    df, order = prepare_series(ev, KIND_ORDER, some_blocks(ev.count()) // 8)
    rolled = add_rolling_mean(df, "value", [6, 24], order).select("event_id", "roll_mean_6", "roll_mean_24")
    return steady(rolled, "roll_mean_6", "roll_mean_24")


@query("select event_id, lead(value, 6) over (partition by user_id order by ts, event_id) as value from events")
def shift_target_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), USER_ORDER)
    return shift_target(df, "value", 6, order).select("event_id", "value")


@query("select event_id, lead(value, 24) over (order by ts, event_id) as value from events")
def shift_target_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("ts", "event_id", "value")
    df, order = prepare_series(ev, LONG_ORDER, some_blocks(ev.count()))
    return shift_target(df, "value", 24, order).select("event_id", "value")


_CIRCLES = [("hour", 24), ("dow", 7), ("month", 12)]


@query(
    "select event_id, hour, dow, month, "
    + ", ".join(f"{steady_sql(f'{f}(2 * pi() * {c} / {n}.0)')} as {c}_{f}" for c, n in _CIRCLES for f in ("sin", "cos"))
    + " from (select event_id, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as dow, "
    "cast(month(ts) as int) as month from events)"
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = add_calendar(load(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")
    circled = add_cyclical(ev, dict(_CIRCLES))
    return steady(circled, *[f"{c}_{f}" for c, _ in _CIRCLES for f in ("sin", "cos")])


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events")
def position_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return with_position(ev, USER_ORDER).select("event_id", "pos")


@query("select event_id, row_number() over (order by ts, event_id) - 1 as pos from events")
def position_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("ts", "event_id")
    return with_position(ev, LONG_ORDER, max_series_rows=some_blocks(ev.count())).select("event_id", "pos")


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as pos from events")
def position_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return with_position(ev, KIND_ORDER, max_series_rows=some_blocks(ev.count()) // 8).select("event_id", "pos")


_ORDER_POS = (
    "(select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders)"
)


@query(
    f"select o_orderkey, pos, case when pos < cast(floor(n * cast(0.8 as double)) as bigint) then 'train' else 'test' end as split from {_ORDER_POS}"
)
def holdout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return holdout_split(with_position(orders, ORDERS_ORDER)).select("o_orderkey", "pos", "split")


@query(
    f"select o_orderkey, cast(fold as int) as fold, case when pos < n - (6 - fold) * (n // 6) then 'train' else 'validation' end as role "
    f"from {_ORDER_POS} cross join range(1, 6) f(fold) where pos < n - (5 - fold) * (n // 6)"
)
def expanding_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return expanding_folds(with_position(orders, ORDERS_ORDER), 5).select("o_orderkey", "fold", "role")


@query("select o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 500")
def first_rows_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return head_by_time(with_position(orders, ORDERS_ORDER), 500).select("o_orderkey", "o_totalprice")


def _features_sql(label: str, category: str, prefix: str, levels: tuple[str, ...], ids: str, numeric: str, source: str, series: str) -> str:
    def mean(w: int) -> str:
        frame = f"(w rows between {w} preceding and 1 preceding)"
        return f"case when count(yf) over {frame} = {w} then {steady_sql(f"avg(yf) over {frame}")} end as roll_mean_{w}"

    circles = ", ".join(
        f"{steady_sql(f'{f}(2 * pi() * {part} / {n}.0)')} as {name}_{f}"
        for name, part, n in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12))
        for f in ("sin", "cos")
    )
    hots = ", ".join(f"cast(coalesce({category} = '{v}', false) as int) as {prefix}_{v}" for v in levels)
    return f"""select * exclude (rn) from (
      select {ids}, {numeric}, {hots}, {circles}, rn,
        {steady_sql("lag(yf, 1) over w")} as lag_1, {steady_sql("lag(yf, 2) over w")} as lag_2, {mean(6)}, {mean(24)},
        {label} as label
      from {source} window w as ({series} order by rn))
      where {' and '.join(f'{c} is not null' for c in ['roll_mean_24', 'label', *numeric.replace(' ', '').split(',')])}"""


_LEVELS = ("click", "error", "purchase", "signup", "view")
_USER_FEATURES = _features_sql(
    steady_sql("yf"), "event_type", "type", _LEVELS, "user_id, ts, event_id", "k", "filled", "partition by user_id"
)


@query(f"with {filled_sql()} {_USER_FEATURES}")
def feature_table_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _users(spark, sf_dir)
    built = build_features(df, USER_SPEC, order)
    return _plain(built)


def _plain(built: DataFrame) -> DataFrame:
    circles = [f"{part}_{f}" for part, _ in _CIRCLES for f in ("sin", "cos")]
    return steady(built, *circles, "lag_1", "lag_2", "roll_mean_6", "roll_mean_24", "label")


_LONG_FEATURES = _features_sql(
    steady_sql("lead(yf, 6) over w"), "event_type", "type", _LEVELS, "ts, event_id", "k", "filled", ""
)


@query(f"with {filled_sql('')} {_LONG_FEATURES}")
def feature_table_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _long(spark, sf_dir)
    return _plain(build_features(df, USER_SPEC, order, horizon=6))


_HOURLY_FILLED = f"""{HOURLY},
numbered as (select *, row_number() over (order by ts) as rn from hourly),
neighbours as (
  select *,
    last_value(case when y is not null then rn end ignore nulls) over back as lp,
    last_value(y ignore nulls) over back as lv,
    first_value(case when y is not null then rn end ignore nulls) over ahead as np,
    first_value(y ignore nulls) over ahead as nv
  from numbered
  window back as (order by rn rows between unbounded preceding and current row),
         ahead as (order by rn rows between current row and unbounded following)),
filled as (select *, case when y is not null then y when lv is null then nv when nv is null then lv
              else lv + (rn - lp) * ((nv - lv) / (np - lp)) end as yf from neighbours)"""


@query(
    f"with {_HOURLY_FILLED} "
    + _features_sql(steady_sql("lead(yf, 6) over w"), "cat", "cat", _LEVELS, "ts", "x1, x2, x3, f1, f2", "filled", "")
)
def feature_table_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(hourly(spark, sf_dir), HOURLY_ORDER)
    return _plain(build_features(df, HOURLY_SPEC, order, horizon=6))


@query(f"with {_HOURLY_FILLED} select ts, {steady_sql('yf')} as y from filled")
def filled_hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = prepare_series(hourly(spark, sf_dir), HOURLY_ORDER)
    return steady(interpolate_linear(df, "y", order).select("ts", "y"), "y")


@query(
    f"with {pair_features_sql((0, 6, 24))} select horizon, user_id, ts, event_id, {steady_sql('a')} as lag_1, "
    f"{steady_sql('b')} as roll_mean_6, {steady_sql('y')} as label from pairs"
)
def horizon_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = _users(spark, sf_dir)
    return steady(horizon_features(df, PAIR_SPEC, order, [0, 6, 24]), "lag_1", "roll_mean_6", "label")
