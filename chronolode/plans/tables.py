"""Catalog: scans, sinks, projections, filters, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.encoding import (
    SEASONS,
    Bands,
    HourOfDay,
    Mapped,
    Positive,
    Quantiles,
    as_item,
    bucket_hours,
    cut_bands,
    cut_quantiles,
    discretize,
    flag_positive,
    map_values,
    one_hot,
    to_transactions,
    wide_transactions,
)
from chronolode.functions.quantiles import quantile_edges
from chronolode.operators.ordering import order_by_time
from chronolode.operators.profile import mean_by
from chronolode.operators.scoring import scores_long
from chronolode.operators.series import complete_rows
from chronolode.plans.inputs import (
    BASKETS,
    FOLD_SCORES,
    ORDERS_ORDER,
    USER_EVENTS,
    baskets,
    fold_scores,
    some_blocks,
    user_events,
)
from chronolode.plans.registry import query, rounded
from chronolode.sources.observations import read_observations, with_month_start, with_timestamp
from chronolode.sources.scratch import scratch_path
from chronolode.sources.tables import load, to_table, write_table


@query(f"with {USER_EVENTS} select event_id, user_id, event_type, y from ev")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-csv")
    write_table(user_events(spark, sf_dir).select("event_id", "user_id", "event_type", "y"), path)
    schema = "event_id long, user_id long, event_type string, y double"
    return read_observations(spark, path, schema)


@query(f"with {USER_EVENTS} select event_id, case when event_type <> 'view' then event_type end as event_type, y from ev")
def csv_scan_many_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-csv")
    write_table(user_events(spark, sf_dir).select("event_id", "event_type", "y"), path)
    schema = "event_id long, event_type string, y double"
    return read_observations(spark, path, schema, null_values=("NA", "view"))


@query(
    "select o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 7, 0, 0) as ts, "
    "cast(date_trunc('month', o_orderdate) as timestamp) as month_start from orders"
)
def timestamp_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"),
        F.lit(7).alias("hour"),
    )
    stamped = with_timestamp(parts, {c: c for c in ("year", "month", "day", "hour")})
    return with_month_start(stamped, "year", "month").select("o_orderkey", "ts", "month_start")


@query("select o_orderdate, o_orderkey, o_totalprice from orders order by 1, 2")
def time_ordered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return order_by_time(kept, ORDERS_ORDER)


@query("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity >= 45")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return kept.where(F.col("l_quantity") >= 45)


@query("select event_type, round(avg(value), 6) as mean from events group by 1")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "means")
    write_table(rounded(mean_by(load(spark, sf_dir, "events"), "event_type", "value"), "mean"), path)
    return read_observations(spark, path, "event_type string, mean double")


@query(
    f"with {BASKETS} select o_orderkey, '[' || string_agg('\"' || item || '\"', ',' order by item) || ']' as items "
    "from tx group by 1"
)
def nested_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "baskets-csv")
    write_table(baskets(spark, sf_dir), path)
    return spark.read.schema("o_orderkey long, items string").option("header", True).option("escape", "\\").csv(path)


@query(
    "select * from (values ('l_quantity'), ('l_extendedprice')) v(name), lateral (select "
    "round(quantile_cont(case name when 'l_quantity' then l_quantity else l_extendedprice end, 1/3.0), 6) as lower_edge, "
    "round(quantile_cont(case name when 'l_quantity' then l_quantity else l_extendedprice end, 2/3.0), 6) as upper_edge "
    "from lineitem) order by 1"
)
def driver_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice"]
    found = quantile_edges(load(spark, sf_dir, "lineitem"), cols, [1 / 3, 2 / 3])
    rows = [(c, *[float(v) for v in found[c]]) for c in cols]
    return rounded(
        to_table(spark, rows, "name string, lower_edge double, upper_edge double"), "lower_edge", "upper_edge"
    )


@query("select * exclude (l_returnflag, l_linestatus, l_shipdate) from lineitem")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")


@query("select l_orderkey, nullif(l_tax, 0) as tax from lineitem where l_tax <> 0")
def complete_rows_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_rows(load(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("tax")))


@query(
    "select l_orderkey, nullif(l_tax, 0) as tax, nullif(l_discount, 0) as discount from lineitem where l_discount <> 0"
)
def complete_rows_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )
    return complete_rows(rows, ["discount"])


@query(f"with {FOLD_SCORES} select * from fold_scores where algorithm = 'click'")
def equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scores(spark, sf_dir).where(F.col("algorithm") == "click")


@query(
    "select o_orderkey, 6 as horizon, o_orderpriority || ' [Tuned]' as name, "
    "regexp_replace(o_orderpriority, '^\\d-', '') as plain from orders"
)
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit(6).alias("horizon"),
        F.concat("o_orderpriority", F.lit(" [Tuned]")).alias("name"),
        F.regexp_replace("o_orderpriority", r"^\d-", "").alias("plain"),
    )


@query(
    "select event_id, "
    + ", ".join(
        f"cast(coalesce(event_type = '{v}', false) as int) as type_{v}"
        for v in ("click", "purchase", "signup", "view")
    )
    + " from (select event_id, nullif(event_type, 'error') as event_type from events)"
)
def one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return one_hot(ev, "event_type", "type")


@query(
    "select l_orderkey, l_extendedprice, case when l_extendedprice <= 1000 then null when l_extendedprice <= 20000 then 'Low' "
    "when l_extendedprice <= 60000 then 'Mid' when l_extendedprice <= 100000 then 'High' end as band from lineitem"
)
def fixed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return cut_bands(rows, "l_extendedprice", [1000, 20000, 60000, 100000], ["Low", "Mid", "High"], "band")


@query(
    "select l_quantity, case when l_quantity <= 0 then null when l_quantity <= 17 then 'S' when l_quantity <= 34 then 'M' "
    "else 'L' end as band, count(*) as n from lineitem group by all"
)
def fixed_bands_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_quantity")
    cut = cut_bands(rows, "l_quantity", [0, 17, 34, float("inf")], ["S", "M", "L"], "band")
    return cut.groupBy("l_quantity", "band").agg(F.count("*").alias("n"))


_TERTILES = {"l_quantity": "qty", "l_discount": "disc", "l_tax": "tax", "l_extendedprice": "price"}
_TERTILES_SQL = (
    "with e as (select "
    + ", ".join(
        f"quantile_cont({c}, {k}/3.0) as {out}{k}" for c, out in _TERTILES.items() for k in (1, 2)
    )
    + " from lineitem) select "
    + ", ".join(
        f"case when {c} <= {out}1 then 'Low' when {c} <= {out}2 then 'Med' else 'High' end as {out}"
        for c, out in _TERTILES.items()
    )
    + ", count(*) as n from lineitem cross join e group by all"
)


def _tertile_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*_TERTILES.values()).agg(F.count("*").alias("n"))


@query(_TERTILES_SQL)
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(*_TERTILES)
    return _tertile_counts(cut_quantiles(rows, _TERTILES))


@query(
    "select "
    + ", ".join(
        f"round(quantile_cont({c}, {p}), 6) as {c}_{i}"
        for c in ("l_extendedprice", "l_quantity")
        for i, p in enumerate((0.0, 0.25, 0.5, 0.995, 1.0))
    )
    + " from lineitem"
)
def quantiles_by_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for columns too large for one task, forced at any scale."""
    rows = load(spark, sf_dir, "lineitem")
    cols, probs = ["l_extendedprice", "l_quantity"], [0.0, 0.25, 0.5, 0.995, 1.0]
    found = quantile_edges(rows, cols, probs, max_rows=some_blocks(rows.count()) // 20)
    names = [f"{c}_{i}" for c in cols for i in range(len(probs))]
    values = [v for c in cols for v in found[c]]
    return rounded(to_table(spark, [values], ", ".join(f"{n} double" for n in names)), *names)


_SEASON_SQL = "case when month({c}) in (12, 1, 2) then 'Winter' when month({c}) in (3, 4, 5) then 'Spring' when month({c}) in (6, 7, 8) then 'Summer' else 'Autumn' end"


@query(
    f"select o_orderkey, {_SEASON_SQL.format(c='o_orderdate')} as season, "
    "case month(o_orderdate) when 1 then 'first' end as unmapped from orders"
)
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        map_values(month, SEASONS).alias("season"),
        map_values(month, {1: "first"}).alias("unmapped"),
    )


@query(
    "select event_id, case when hour(ts) between 5 and 10 then 'Morning' when hour(ts) between 11 and 16 then 'Afternoon' "
    "when hour(ts) between 17 and 21 then 'Evening' else 'Night' end as part from events"
)
def hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", bucket_hours(F.hour("ts")).alias("part"))


@query(
    "select c_custkey, case when c_acctbal > 5000 then 'Yes' else 'No' end as rich, "
    "'SEG=' || nullif(c_mktsegment, 'MACHINERY') as segment from customer"
)
def flags_and_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        flag_positive(F.col("c_acctbal") - 5000).alias("rich"),
        as_item(F.nullif("c_mktsegment", F.lit("MACHINERY")), "SEG").alias("segment"),
    )


EVENT_RULES = [
    Bands("VALUE", "y", (-0.1, 20.0, 60.0, 150.0, float("inf")), ("Good", "Moderate", "Bad", "Hazardous")),
    Quantiles("K", "k"),
    Mapped("SEASON", "month"),
    HourOfDay("TIME", "hour"),
    Positive("BIG", "excess"),
]


def event_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).withColumns(
        {"month": F.month("ts"), "hour": F.hour("ts"), "excess": F.col("y") - 100}
    )


EVENT_ITEMS = f"""{USER_EVENTS},
ke as (select quantile_cont(k, 1/3.0) as e1, quantile_cont(k, 2/3.0) as e2 from ev),
event_items as (
  select event_id,
    'VALUE=' || case when y <= -0.1 then null when y <= 20 then 'Good' when y <= 60 then 'Moderate' when y <= 150 then 'Bad'
                     when y > 150 then 'Hazardous' end as VALUE,
    'K=' || case when k <= e1 then 'Low' when k <= e2 then 'Med' when k > e2 then 'High' end as K,
    'SEASON=' || {_SEASON_SQL.format(c='ts')} as SEASON,
    'TIME=' || case when hour(ts) between 5 and 10 then 'Morning' when hour(ts) between 11 and 16 then 'Afternoon'
                    when hour(ts) between 17 and 21 then 'Evening' else 'Night' end as TIME,
    'BIG=' || case when y - 100 > 0 then 'Yes' else 'No' end as BIG
  from ev cross join ke)"""


@query(f"with {EVENT_ITEMS} select * from event_items")
def discretized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discretize(event_conditions(spark, sf_dir), EVENT_RULES, keep=["event_id"])


@query(
    f"with {EVENT_ITEMS}, tx as (select event_id, VALUE as item from event_items union all select event_id, K from event_items "
    "union all select event_id, SEASON from event_items union all select event_id, TIME from event_items "
    "union all select event_id, BIG from event_items) "
    "select event_id, string_agg(item, ', ' order by item) as items, count(item) as n from tx group by 1"
)
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = discretize(event_conditions(spark, sf_dir), EVENT_RULES, keep=["event_id"])
    tx = to_transactions(items, [r.attr for r in EVENT_RULES], "event_id")
    return tx.select("event_id", F.array_join("items", ", ").alias("items"), F.size("items").cast("long").alias("n"))


@query(
    f"with {BASKETS} select o_orderkey, bool_or(item = 'PRICE=High') as price_high, "
    "bool_or(item = 'SEASON=Winter') as season_winter from tx group by 1"
)
def transaction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_transactions(baskets(spark, sf_dir), "o_orderkey", ["PRICE=High", "SEASON=Winter"])
    return wide.select(
        "o_orderkey", F.col("PRICE=High").alias("price_high"), F.col("SEASON=Winter").alias("season_winter")
    )


@query(
    f"with {FOLD_SCORES}, r as (select *, row_number() over (partition by fold order by r2 desc, algorithm) as place "
    "from fold_scores) select algorithm, fold, algorithm as label, place, metric, value from (unpivot r on mae, rmse, r2 "
    "into name metric value value)"
)
def chart_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scores_long(fold_scores(spark, sf_dir), ids=["algorithm", "fold"])
    return long.withColumn("place", F.col("place").cast("long"))
