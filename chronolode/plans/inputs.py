"""Inputs of the catalog, derived by Spark from the given tables, each with the
same view in SQL (a ``with`` list that a query continues)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.calendar import period_start
from chronolode.functions.encoding import (
    Category,
    Mapped,
    cut_quantiles,
    discretize,
    to_baskets,
    to_transactions,
)
from chronolode.operators.features import FeatureSpec
from chronolode.operators.ordering import MAX_SERIES_ROWS, TimeOrder
from chronolode.sources.scratch import materialise
from chronolode.sources.tables import load

USER_ORDER = TimeOrder("ts", ties=("event_id",), keys=("user_id",))
KIND_ORDER = TimeOrder("ts", ties=("event_id",), keys=("event_type",))
LONG_ORDER = TimeOrder("ts", ties=("event_id",))
HOURLY_ORDER = TimeOrder("ts")
ORDERS_ORDER = TimeOrder("o_orderdate", ties=("o_orderkey",))

SCORE_NAMES = ["click", "error", "purchase", "signup", "view"]


def some_blocks(rows: int) -> int:
    """A block size that cuts a table in at least eight blocks, so that long
    series are handled as such at every scale."""
    return min(MAX_SERIES_ROWS, max(500, rows // 8))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a gappy measure ``y`` and a number ``k`` out of their JSON."""
    return load(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("y"),
    )


USER_EVENTS = """ev as (
  select user_id, ts, event_id, event_type,
         cast(json_extract_string(props, '$.k') as int) as k,
         case when event_type <> 'error' then value end as y
  from events)"""


def filled_sql(series: str = "partition by user_id", fill: str = "linear") -> str:
    """``filled``: the events with gaps of ``y`` filled as ``yf``, numbered by
    ``rn`` within their series."""
    value = {
        "linear": """case when y is not null then y when lv is null then nv when nv is null then lv
              else lv + (rn - lp) * ((nv - lv) / (np - lp)) end""",
        "ffill": "coalesce(y, lv)",
    }[fill]
    return f"""{USER_EVENTS},
numbered as (select *, row_number() over ({series} order by ts, event_id) as rn from ev),
neighbours as (
  select *,
    last_value(case when y is not null then rn end ignore nulls) over back as lp,
    last_value(y ignore nulls) over back as lv,
    first_value(case when y is not null then rn end ignore nulls) over ahead as np,
    first_value(y ignore nulls) over ahead as nv
  from numbered
  window back as ({series} order by rn rows between unbounded preceding and current row),
         ahead as ({series} order by rn rows between current row and unbounded following)),
filled as (select user_id, ts, event_id, event_type, k, y, rn, {value} as yf from neighbours)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series over all events, with gaps where an hour saw no error."""
    ev = load(spark, sf_dir, "events")
    hour = period_start(F.col("ts"), "hour")
    kind, value = F.col("event_type"), F.col("value")
    per_hour = ev.groupBy(hour.alias("ts")).agg(
        F.round(F.avg(F.when(kind == "error", value)), 6).alias("y"),
        F.max_by("event_type", "event_id").alias("cat"),
        F.round(F.sum("value"), 6).alias("x1"),
        F.round(F.avg("user_id"), 6).alias("x2"),
        F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("x3"),
        F.count_if(kind == "signup").alias("f1"),
        F.count_if((kind == "purchase") & (value > 100)).alias("f2"),
    )
    span = ev.agg(F.min(hour).alias("a"), F.max(hour).alias("b"))
    hours = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    # written: the series is short, the events behind it need not be
    return materialise(hours.join(per_hour, "ts", "left").fillna(0, ["f1", "f2"]), "hourly")


HOURLY = """g as (select unnest(generate_series(
    (select date_trunc('hour', min(ts)) from events),
    (select date_trunc('hour', max(ts)) from events), interval 1 hour)) as ts),
a as (
  select date_trunc('hour', ts) as h,
    round(avg(value) filter (where event_type = 'error'), 6) as y,
    max_by(event_type, event_id) as cat,
    round(sum(value), 6) as x1, round(avg(user_id), 6) as x2,
    round(avg(cast(json_extract_string(props, '$.k') as int)), 6) as x3,
    count(*) filter (where event_type = 'signup') as f1,
    count(*) filter (where event_type = 'purchase' and value > 100) as f2
  from events group by 1),
hourly as (
  select cast(g.ts as timestamp) as ts, y, x1, x2, x3, cat, coalesce(f1, 0) as f1, coalesce(f2, 0) as f2
  from g left join a on g.ts = a.h)"""

HOURLY_SPEC = FeatureSpec(
    label="y",
    numeric=("x1", "x2", "x3", "f1", "f2"),
    category="cat",
    category_prefix="cat",
    levels=("click", "error", "purchase", "signup", "view"),
)

USER_SPEC = FeatureSpec(
    label="y",
    numeric=("k",),
    category="event_type",
    category_prefix="type",
    levels=("click", "error", "purchase", "signup", "view"),
)

# Two features: small enough for SQL to solve the same regression.
PAIR_SPEC = FeatureSpec(label="y", lags=(1,), windows=(6,), calendar=False)


def pair_features_sql(horizons: tuple[int, ...] = (0,)) -> str:
    """``pairs``: ``horizon, pos, a (lag_1), b (roll_mean_6), y, n`` over all users,
    numbered by time within a horizon."""
    leads = ", ".join(f"lead(yf, {h}) over w as y{h}" for h in horizons)
    stack = " union all ".join(f"select {h} as horizon, user_id, ts, event_id, a, b, y{h} as y from wide" for h in horizons)
    return f"""{filled_sql()},
wide as (
  select user_id, ts, event_id, lag(yf, 1) over w as a,
    case when count(yf) over (w rows between 6 preceding and 1 preceding) = 6
         then avg(yf) over (w rows between 6 preceding and 1 preceding) end as b,
    {leads}
  from filled window w as (partition by user_id order by rn)),
pairs as (
  select *, row_number() over (partition by horizon order by ts, event_id, user_id) - 1 as pos,
         count(*) over (partition by horizon) as n
  from ({stack}) where a is not null and b is not null and y is not null)"""


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with three small whole-number features and the price as label."""
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.month("o_orderdate").alias("m"),
        F.weekday("o_orderdate").alias("d"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
        F.col("o_totalprice").alias("label"),
    )


ORDER_FACTS = """facts as (
  select o_orderkey, month(o_orderdate) as m, isodow(o_orderdate) - 1 as d,
         cast(o_orderpriority[1] as int) as p, o_totalprice as y,
         row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n
  from orders),
train as (select * from facts where pos < cast(floor(n * 0.8) as bigint))"""

ORDER_FEATURES = ["m", "d", "p"]

BASKET_RULES = [
    Category("PRICE", "price"),
    Category("BAL", "bal"),
    Category("STATUS", "o_orderstatus"),
    Category("PRIO", "o_orderpriority"),
    Category("SEG", "c_mktsegment"),
    Mapped("SEASON", "month"),
]


def order_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their price band and their customer's balance band and
    segment. Bands are cut before the join, so that their edges do not need it."""
    customers = cut_quantiles(load(spark, sf_dir, "customer"), {"c_acctbal": "bal"})
    orders = cut_quantiles(load(spark, sf_dir, "orders"), {"o_totalprice": "price"})
    return (
        orders
        .join(customers.select("c_custkey", "bal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("month", F.month("o_orderdate"))
    )


def weighted_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sets of six items and the number of orders with each."""
    items = discretize(order_conditions(spark, sf_dir), BASKET_RULES)
    return to_baskets(items, [r.attr for r in BASKET_RULES])


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six items per order."""
    items = discretize(order_conditions(spark, sf_dir), BASKET_RULES, keep=["o_orderkey"])
    return to_transactions(items, [r.attr for r in BASKET_RULES], "o_orderkey")


BASKETS = """pe as (select quantile_cont(o_totalprice, 1/3.0) as e1, quantile_cont(o_totalprice, 2/3.0) as e2 from orders),
be as (select quantile_cont(c_acctbal, 1/3.0) as e1, quantile_cont(c_acctbal, 2/3.0) as e2 from customer),
conditions as (
  select o_orderkey,
    'PRICE=' || case when o_totalprice <= pe.e1 then 'Low' when o_totalprice <= pe.e2 then 'Med' else 'High' end as price,
    'BAL=' || case when c_acctbal <= be.e1 then 'Low' when c_acctbal <= be.e2 then 'Med' else 'High' end as bal,
    'STATUS=' || o_orderstatus as status, 'PRIO=' || o_orderpriority as prio, 'SEG=' || c_mktsegment as seg,
    'SEASON=' || case when month(o_orderdate) in (12, 1, 2) then 'Winter' when month(o_orderdate) in (3, 4, 5) then 'Spring'
                      when month(o_orderdate) in (6, 7, 8) then 'Summer' else 'Autumn' end as season
  from orders join customer on o_custkey = c_custkey cross join pe cross join be),
tx as (
  select o_orderkey, price as item from conditions union all select o_orderkey, bal from conditions
  union all select o_orderkey, status from conditions union all select o_orderkey, prio from conditions
  union all select o_orderkey, seg from conditions union all select o_orderkey, season from conditions),
total as (select count(*) as n from conditions)"""


# The same orders as counted distinct rows of their six items; few at any scale.
COUNTED = """pe as (select quantile_cont(o_totalprice, 1/3.0) as e1, quantile_cont(o_totalprice, 2/3.0) as e2 from orders),
be as (select quantile_cont(c_acctbal, 1/3.0) as e1, quantile_cont(c_acctbal, 2/3.0) as e2 from customer),
combos as materialized (
  select *, row_number() over (order by price, bal, status, prio, seg, season) as o from (
    select 'PRICE=' || case when o_totalprice <= pe.e1 then 'Low' when o_totalprice <= pe.e2 then 'Med' else 'High' end as price,
      'BAL=' || case when c_acctbal <= be.e1 then 'Low' when c_acctbal <= be.e2 then 'Med' else 'High' end as bal,
      'STATUS=' || o_orderstatus as status, 'PRIO=' || o_orderpriority as prio, 'SEG=' || c_mktsegment as seg,
      'SEASON=' || case when month(o_orderdate) in (12, 1, 2) then 'Winter' when month(o_orderdate) in (3, 4, 5) then 'Spring'
                        when month(o_orderdate) in (6, 7, 8) then 'Summer' else 'Autumn' end as season, count(*) as w
    from orders join customer on o_custkey = c_custkey cross join pe cross join be group by all)),
tx as materialized (
  select o, w, price as item from combos union all select o, w, bal from combos union all select o, w, status from combos
  union all select o, w, prio from combos union all select o, w, seg from combos union all select o, w, season from combos),
total as materialized (select cast(sum(w) as bigint) as n from combos)"""


def itemsets_sql(min_support: float, max_len: int) -> str:
    """``freq``: ``s (joined text), items (list), k, n_tx, support`` by self-joins."""
    parts = [COUNTED]
    for k in range(1, max_len + 1):
        names = [f"t{i}.item" for i in range(1, k + 1)]
        joins = "".join(f" join tx t{i} on t{i}.o = t1.o and t{i}.item > t{i - 1}.item" for i in range(2, k + 1))
        parts.append(
            f"f{k} as materialized (select [{', '.join(names)}] as items, cast(sum(t1.w) as bigint) as n_tx from tx t1{joins} "
            f"group by all having cast(sum(t1.w) as bigint) / (select n from total) >= {min_support})"
        )
    stacked = " union all ".join(f"select items, n_tx from f{k}" for k in range(1, max_len + 1))
    parts.append(
        f"freq as materialized (select items, n_tx, n_tx / n as support, array_to_string(items, ', ') as s, len(items) as k "
        f"from ({stacked}) cross join total)"
    )
    return ",\n".join(parts)


def rules_sql(min_support: float, max_len: int, min_confidence: float) -> str:
    """``rules``: every split of every frequent set, written out."""

    def side(k: int, mask: int, bit: int) -> str:
        return " || ', ' || ".join(f"items[{i + 1}]" for i in range(k) if mask >> i & 1 == bit)

    splits = " union all ".join(
        f"select support, {side(k, mask, 1)} as antecedent, {side(k, mask, 0)} as consequent from freq where k = {k}"
        for k in range(2, max_len + 1)
        for mask in range(1, 2**k - 1)
    )
    return f"""{itemsets_sql(min_support, max_len)},
splits as materialized ({splits}),
rules as materialized (
  select antecedent, consequent, splits.support, splits.support / fa.support as confidence,
         (splits.support / fa.support) / fc.support as lift
  from splits join freq fa on fa.s = antecedent join freq fc on fc.s = consequent
  where splits.support / fa.support >= {min_confidence})"""


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five score rows from the events: a model per event type, five folds
    by day of month."""
    fold = ((F.dayofmonth("ts") - 1) % 5 + 1).cast("int")
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("algorithm"), fold.alias("fold"))
        .agg(
            F.round(F.avg("value") / 100, 9).alias("mae"),
            F.round(F.stddev_pop("value") / 100, 9).alias("rmse"),
        )
        .withColumn("r2", F.round(1 - F.col("rmse") * F.col("rmse"), 9))
    )


FOLD_SCORES = """fold_scores as (
  select *, round(1 - rmse * rmse, 9) as r2 from (
    select event_type as algorithm, cast((day(ts) - 1) % 5 + 1 as int) as fold,
           round(avg(value) / 100, 9) as mae, round(stddev_pop(value) / 100, 9) as rmse
    from events group by 1, 2))"""

SCORES_LONG = f"""{FOLD_SCORES},
scores as (
  select algorithm, fold, 'mae' as metric, mae as value from fold_scores
  union all select algorithm, fold, 'rmse', rmse from fold_scores
  union all select algorithm, fold, 'r2', r2 from fold_scores)"""
