"""Catalog: itemsets, rules and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions.encoding import to_transactions
from chronolode.functions.quantiles import quantile
from chronolode.operators.itemsets import (
    association_rules,
    candidate_sets,
    closed_itemsets,
    common_and_rare_rules,
    frequent_itemsets,
    item_support,
    itemsets_of_closed,
    maximal_itemsets,
    mine_conditions,
    rare_rules,
    rules_for_consequents,
    rules_for_prefix,
    top_rules,
)
from chronolode.operators.ordering import prepare_series
from chronolode.operators.profile import (
    ProfileSpec,
    band_counts,
    box_stats,
    correlation_matrix,
    describe_frame,
    histogram,
    mean_by,
    missing_by_period,
    profile,
)
from chronolode.operators.series import interpolate_linear
from chronolode.operators.vertical import itemsets_by_bitmaps as by_bitmaps
from chronolode.plans.inputs import (
    BASKET_RULES,
    BASKETS,
    USER_EVENTS,
    USER_ORDER,
    baskets,
    filled_sql,
    itemsets_sql,
    order_conditions,
    rules_sql,
    some_blocks,
    user_events,
    weighted_baskets,
)
from chronolode.plans.registry import query, rounded
from chronolode.plans.tables import EVENT_ITEMS, EVENT_RULES, event_conditions
from chronolode.sources.scratch import materialise
from chronolode.sources.tables import load, to_table

_RULE_COLS = ["antecedent", "consequent", "support", "confidence", "lift"]
_RULE_SQL = "antecedent, consequent, round(support, 9) as support, round(confidence, 9) as confidence, round(lift, 9) as lift"


def _rules(df: DataFrame) -> DataFrame:
    return rounded(df.select(*_RULE_COLS), "support", "confidence", "lift", places=9)


def _itemset_text(df: DataFrame) -> DataFrame:
    return df.withColumn("itemset", F.array_join("itemset", ", "))


@query(
    f"with {BASKETS} select item, count(*) as n_tx, round(count(*) / (select n from total), 9) as support from tx "
    "group by 1 having count(*) / (select n from total) >= 0.2"
)
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(item_support(baskets(spark, sf_dir), 0.2), "support", places=9)


@query(
    f"with {itemsets_sql(0.03, 2)}, f2s as (select items[1] as a, items[2] as b from freq where k = 2) "
    "select x.a || ', ' || x.b || ', ' || y.b as itemset from f2s x join f2s y on x.a = y.a and x.b < y.b "
    "join f2s z on z.a = x.b and z.b = y.b"
)
def candidate_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = frequent_itemsets(weighted_baskets(spark, sf_dir), 0.03, 2, weight="w").where(F.size("itemset") == 2)
    return _itemset_text(candidate_sets(pairs))


@query(f"with {itemsets_sql(0.02, 3)} select s as itemset, n_tx, round(support, 9) as support from freq")
def itemsets_up_to_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_itemset_text(frequent_itemsets(baskets(spark, sf_dir), 0.02, 3)), "support", places=9)


@query(f"with {itemsets_sql(0.006, 4)} select s as itemset, n_tx, round(support, 9) as support from freq")
def itemsets_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for many distinct baskets, forced at any scale."""
    found = frequent_itemsets(weighted_baskets(spark, sf_dir), 0.006, 4, weight="w", max_subsets=0)
    return rounded(_itemset_text(found), "support", places=9)


@query(f"with {itemsets_sql(0.006, 4)} select s as itemset, n_tx, round(support, 9) as support from freq")
def itemsets_by_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_bitmaps(weighted_baskets(spark, sf_dir), 0.006, 4, weight="w")
    return rounded(_itemset_text(found), "support", places=9)


@query(f"with {rules_sql(0.02, 3, 0.2)} select {_RULE_SQL} from rules")
def rules_all_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(association_rules(frequent_itemsets(baskets(spark, sf_dir), 0.02, 3), 0.2))


# Orders with items that follow from others, rush from priority and half from quarter, so
# that some sets always occur together.
_LINKED = """tx as materialized (
  select o_orderkey as o, unnest([
    'PRIO=' || o_orderpriority,
    'RUSH=' || case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Yes' else 'No' end,
    'STATUS=' || o_orderstatus,
    'QUARTER=' || quarter(o_orderdate),
    'HALF=' || ((quarter(o_orderdate) + 1) // 2)]) as item from orders),
total as (select count(*) as n from orders)"""


def _linked_sql(min_support: float, max_len: int) -> str:
    """``freq`` over ``tx``: items (list), k, n_tx, support."""
    parts = [_LINKED]
    for k in range(1, max_len + 1):
        names = [f"t{i}.item" for i in range(1, k + 1)]
        joins = "".join(f" join tx t{i} on t{i}.o = t1.o and t{i}.item > t{i - 1}.item" for i in range(2, k + 1))
        parts.append(f"f{k} as materialized (select [{', '.join(names)}] as items, count(*) as n_tx from tx t1{joins} group by all having count(*) / (select n from total) >= {min_support})")
    stacked = " union all ".join(f"select items, n_tx from f{k}" for k in range(1, max_len + 1))
    parts.append(f"freq as materialized (select items, len(items) as k, n_tx, n_tx / n as support from ({stacked}) cross join total)")
    return ",\n".join(parts)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    rush = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Yes").otherwise("No")
    quarter = F.quarter("o_orderdate")
    items = orders.select(
        "o_orderkey",
        F.concat(F.lit("PRIO="), "o_orderpriority").alias("prio"),
        F.concat(F.lit("RUSH="), rush).alias("rush"),
        F.concat(F.lit("STATUS="), "o_orderstatus").alias("status"),
        F.concat(F.lit("QUARTER="), quarter.cast("string")).alias("quarter"),
        F.concat(F.lit("HALF="), F.floor((quarter + 1) / 2).cast("string")).alias("half"),
    )
    return frequent_itemsets(to_transactions(items, ["prio", "rush", "status", "quarter", "half"], "o_orderkey"), 0.01, 4)


def _sets(df: DataFrame) -> DataFrame:
    return rounded(_itemset_text(df.select("itemset", "n_tx", "support")), "support", places=9)


_LINKED_ROW = "array_to_string(items, ', ') as itemset, n_tx, round(support, 9) as support"


@query(
    f"with {_linked_sql(0.01, 4)} select {_LINKED_ROW} from freq x where not exists "
    "(select 1 from freq y where y.k > x.k and y.n_tx = x.n_tx and list_has_all(y.items, x.items))"
)
def closed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(closed_itemsets(_linked(spark, sf_dir)))


@query(
    f"with {_linked_sql(0.01, 4)} select {_LINKED_ROW} from freq x where not exists "
    "(select 1 from freq y where y.k > x.k and list_has_all(y.items, x.items))"
)
def maximal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(maximal_itemsets(_linked(spark, sf_dir)))


@query(
    f"with {_linked_sql(0.01, 4)}, "
    "r as (select x.items as a, y.items as s, y.support / x.support as confidence from freq x join freq y on y.k > x.k and list_has_all(y.items, x.items)) "
    "select array_to_string(a, ', ') as antecedent, array_to_string(list_filter(s, lambda i: not list_contains(a, i)), ', ') as consequent, "
    "round(confidence, 9) as confidence from r where confidence >= 0.6"
)
def rules_of_closed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sets lose no rule: those of the sets they stand for are all rules."""
    frequent = materialise(itemsets_of_closed(closed_itemsets(_linked(spark, sf_dir))), "itemsets")
    return rounded(association_rules(frequent, 0.6).select("antecedent", "consequent", "confidence"), "confidence", places=9)


def _general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_rules(frequent_itemsets(weighted_baskets(spark, sf_dir), 0.02, 3, weight="w"), 0.2)


@query(f"with {rules_sql(0.02, 3, 0.2)} select {_RULE_SQL} from rules order by rules.lift desc, 1, 2 limit 15")
def top_rules_by_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(top_rules(_general(spark, sf_dir), 15))


@query(f"with {rules_sql(0.02, 3, 0.2)} select {_RULE_SQL} from rules where starts_with(consequent, 'PRICE=')")
def rules_with_price_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(rules_for_prefix(_general(spark, sf_dir), "PRICE="))


@query(
    f"with {rules_sql(0.02, 3, 0.2)} select {_RULE_SQL} from rules where consequent in ('PRICE=High', 'BAL=Low') "
    "order by rules.lift desc, 1, 2"
)
def rules_with_listed_consequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(rules_for_consequents(_general(spark, sf_dir), ["PRICE=High", "BAL=Low"]))


@query(f"with {rules_sql(0.006, 4, 0.2)} select {_RULE_SQL} from rules where consequent in ('PRIO=1-URGENT', 'SEG=BUILDING')")
def rare_band_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(rare_rules(weighted_baskets(spark, sf_dir), ["PRIO=1-URGENT", "SEG=BUILDING"], 0.006, 0.2, 4, "w"))


@query(
    f"select 'common' as kind, * from (with {rules_sql(0.02, 3, 0.3)} select {_RULE_SQL} from rules where starts_with(consequent, 'PRICE=')) "
    f"union all select 'rare', * from (with {rules_sql(0.006, 4, 0.2)} select {_RULE_SQL} from rules where consequent in ('PRIO=1-URGENT', 'SEG=BUILDING'))"
)
def common_and_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule tables from one mining pass."""
    rare = ["PRIO=1-URGENT", "SEG=BUILDING"]
    common, rare = common_and_rare_rules(
        weighted_baskets(spark, sf_dir), "PRICE=", rare, (0.02, 0.3, 3), (0.006, 0.2, 4), "w"
    )
    marked = [_rules(t).withColumn("kind", F.lit(k)) for k, t in (("common", common), ("rare", rare))]
    return marked[0].unionByName(marked[1])


@query(f"with {rules_sql(0.03, 3, 0.3)} select {_RULE_SQL} from rules")
def order_condition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rules = mine_conditions(order_conditions(spark, sf_dir), BASKET_RULES, 0.03, 0.3, 3)
    return _rules(rules)


_EVENT_TX = f"""{EVENT_ITEMS},
tx as (select event_id as t, VALUE as item from event_items where VALUE is not null
  union all select event_id, K from event_items union all select event_id, SEASON from event_items
  union all select event_id, TIME from event_items union all select event_id, BIG from event_items),
n as (select count(*) as n from event_items),
f1 as (select item as s, count(*) / (select n from n) as support from tx group by 1 having count(*) / (select n from n) >= 0.05),
f2 as (select a.item as x, b.item as y, count(*) / (select n from n) as support from tx a join tx b on a.t = b.t and a.item < b.item
  group by 1, 2 having count(*) / (select n from n) >= 0.05),
splits as (select x as antecedent, y as consequent, support from f2 union all select y, x, support from f2)"""


@query(
    f"with {_EVENT_TX} select antecedent, consequent, round(splits.support, 9) as support, "
    "round(splits.support / a.support, 9) as confidence, round(splits.support / a.support / c.support, 9) as lift "
    "from splits join f1 a on a.s = antecedent join f1 c on c.s = consequent where splits.support / a.support >= 0.3"
)
def event_condition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over events: some rows lack an item."""
    _, rules = mine_conditions(event_conditions(spark, sf_dir), EVENT_RULES, 0.05, 0.3, 2)
    return _rules(rules)


@query(
    f"with {USER_EVENTS} select cast(date_trunc('month', ts) as timestamp) as period, "
    "round(avg(case when y is null then 1 else 0 end) * 100, 6) as missing_pct from ev group by 1"
)
def missing_share_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(missing_by_period(user_events(spark, sf_dir), "y", "ts", "month"), "missing_pct")


@query(
    "with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem), "
    "c as (select least(cast(floor((l_extendedprice - lo) / (hi - lo) * 120) as int), 119) as bin, count(*) as n "
    "from lineitem cross join r group by 1) "
    "select cast(g.bin as int) as bin, round(lo + g.bin * ((hi - lo) / 120), 6) as lo, "
    "round(lo + (g.bin + 1) * ((hi - lo) / 120), 6) as hi, coalesce(n, 0) as n "
    "from range(120) g(bin) cross join r left join c on c.bin = g.bin"
)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histogram(load(spark, sf_dir, "lineitem"), "l_extendedprice", 120), "lo", "hi")


_EDGES = [0.0, 20000.0, 60000.0, 100000.0, 200000.0]


@query(
    "select cast(i as int) as band_no, band, lo, hi, (select count(*) from lineitem where l_extendedprice > lo and l_extendedprice <= hi) as n "
    "from (values (0, 'Low', 0.0::double, 20000.0::double), (1, 'Mid', 20000, 60000), (2, 'High', 60000, 100000), "
    "(3, 'Top', 100000, 200000)) v(i, band, lo, hi)"
)
def band_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_counts(load(spark, sf_dir, "lineitem"), "l_extendedprice", _EDGES, ["Low", "Mid", "High", "Top"])


@query("select 0.995::double as p, round(quantile_cont(o_totalprice, 0.995), 6) as value from orders")
def display_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = quantile(load(spark, sf_dir, "orders"), "o_totalprice", 0.995)
    return rounded(to_table(spark, [(0.995, value)], "p double, value double"), "value")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_IN = "(select l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) as l_tax from lineitem)"


@query(
    " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from {_CORR_IN}" for a in _CORR for b in _CORR)
)
def pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(*_CORR[:3], F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return rounded(correlation_matrix(rows, _CORR), "r")


_BOX_SQL = """with v as (select month(l_shipdate) as month, l_extendedprice as v from lineitem),
b as (select month, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from v group by 1),
e as (select v.month, min(v) filter (where v >= q1 - 1.5 * (q3 - q1)) as lo, max(v) filter (where v <= q3 + 1.5 * (q3 - q1)) as hi
  from v join b on b.month = v.month group by 1)
select cast(g.month as int) as month, coalesce(n, 0) as n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(least(lo, q1), 6) as whisker_lo, round(greatest(hi, q3), 6) as whisker_hi
from range(1, 13) g(month) left join b on b.month = g.month left join e on e.month = g.month"""
_BOX_COLS = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]


def _by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("month"), "l_extendedprice")


@query(_BOX_SQL)
def box_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(box_stats(_by_month(spark, sf_dir), "month", "l_extendedprice", list(range(1, 13))), *_BOX_COLS)


@query(_BOX_SQL)
def box_by_long_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for months too large for one task, forced at any scale."""
    rows = _by_month(spark, sf_dir)
    stats = box_stats(rows, "month", "l_extendedprice", list(range(1, 13)), some_blocks(rows.count()) // 4)
    return rounded(stats, *_BOX_COLS)


@query(
    f"with {USER_EVENTS} select event_type, round(avg(k), 6) as mean from "
    "(select nullif(event_type, 'view') as event_type, k from ev) where event_type is not null group by 1"
)
def mean_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = user_events(spark, sf_dir).withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return rounded(mean_by(ev, "event_type", "k"), "mean")


@query(
    "select count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts, 'event_id, user_id, event_type, value, props' as features from events"
)
def frame_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_frame(load(spark, sf_dir, "events"), "ts")


_PROFILE = ProfileSpec(
    ts="ts",
    label="y",
    numeric=("k", "user_id"),
    category="event_type",
    edges=(-0.1, 20.0, 60.0, 150.0, float("inf")),
    labels=("Good", "Moderate", "Bad", "Hazardous"),
    bins=20,
)


@query(
    f"""with {filled_sql()},
span as (select min(yf) as lo, max(yf) as hi from filled),
parts as (
  select 'missing' as part, strftime(date_trunc('month', ts), '%Y-%m') as item, avg(case when y is null then 1 else 0 end) * 100 as value from filled group by 2
  union all select 'series', 'rows', count(yf) from filled
  union all select 'histogram', cast(least(cast(floor((yf - lo) / (hi - lo) * 20) as int), 19) as varchar), count(*) from filled cross join span group by 2
  union all select 'bands', case when yf <= 20 then 'Good' when yf <= 60 then 'Moderate' when yf <= 150 then 'Bad' else 'Hazardous' end, count(*) from filled group by 2
  union all select 'display_cut', '0.995', quantile_cont(yf, 0.995) from filled
  union all select 'correlation', 'k-y', corr(yf, k) from filled
  union all select 'correlation', 'user_id-y', corr(yf, user_id) from filled
  union all select 'correlation', 'k-user_id', corr(k, user_id) from filled
  union all select 'by_month', cast(month(ts) as varchar), quantile_cont(yf, 0.5) from filled group by 2
  union all select 'by_category', event_type, avg(yf) from filled group by 2)
select part, item, round(value, 6) as value from parts"""
)
def whole_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profile tables in one long table of non-empty cells."""
    raw = user_events(spark, sf_dir)
    df, order = prepare_series(raw, USER_ORDER)
    filled = materialise(interpolate_linear(df, "y", order), "filled")
    parts = profile(raw, filled, _PROFILE)
    cells = {
        "missing": (F.date_format("period", "yyyy-MM"), F.col("missing_pct"), F.lit(True)),
        "histogram": (F.col("bin"), F.col("n"), F.col("n") > 0),
        "bands": (F.col("band"), F.col("n"), F.col("n") > 0),
        "display_cut": (F.col("p"), F.col("value"), F.lit(True)),
        "correlation": (F.concat_ws("-", "a", "b"), F.col("r"), F.col("a") < F.col("b")),
        "by_month": (F.col("month"), F.col("median"), F.col("n") > 0),
        "by_category": (F.col("event_type"), F.col("mean"), F.lit(True)),
    }
    stacked = parts["series"].agg(
        F.lit("series").alias("part"), F.lit("rows").alias("item"), F.count("y").cast("double").alias("value")
    )
    for name, (item, value, kept) in cells.items():
        stacked = stacked.unionByName(
            parts[name]
            .where(kept)
            .select(F.lit(name).alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"))
        )
    return rounded(stacked, "value")
