"""Frequent itemsets and association rules.

Transactions are first reduced to distinct baskets with a weight: equal rows
meet in the map-side combine, so one basket holding a third of all rows costs
one row per input task. Every level then runs over distinct baskets only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.functions.encoding import ItemRule, discretize, to_baskets
from chronolode.sources.scratch import materialise

#: Subsets that one aggregate counts, of all baskets and of any single one.
MAX_SUBSETS = 50_000_000
MAX_BASKET_SUBSETS = 20_000


def distinct_baskets(tx: DataFrame, items: str = "items", weight: str | None = None) -> DataFrame:
    """Distinct item arrays and how many transactions have each. ``weight`` names
    a column of counts if the rows of ``tx`` stand for several transactions."""
    rows = F.sum(weight) if weight else F.count("*")
    return tx.groupBy(F.col(items).alias("items")).agg(rows.alias("w"))


def _frequent(counts: DataFrame, n: int, min_support: float) -> DataFrame:
    share = F.col("n_tx") / F.lit(n)
    return counts.select("itemset", "n_tx", share.alias("support")).where(F.col("support") >= min_support)


def _level_one(baskets: DataFrame, n: int, min_support: float) -> DataFrame:
    counts = (
        baskets.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n_tx"))
    ).select(F.array("item").alias("itemset"), "n_tx")
    return _frequent(counts, n, min_support)


def item_support(
    tx: DataFrame, min_support: float = 0.0, items: str = "items", weight: str | None = None
) -> DataFrame:
    """Items held by at least ``min_support`` of the transactions, as
    ``(item, n_tx, support)``."""
    baskets = materialise(distinct_baskets(tx, items, weight), "baskets")
    n = baskets.agg(F.sum("w")).first()[0] or 1
    return _level_one(baskets, n, min_support).select(F.col("itemset")[0].alias("item"), "n_tx", "support")


def candidate_sets(frequent: DataFrame) -> DataFrame:
    """Sets of one item more whose subsets are all among ``frequent``, sets of
    one common size, two or more, with sorted items. Two sets that agree but for
    the last item join; the remaining subsets are looked up by equi-join."""
    sets = frequent.select("itemset")
    stem = F.slice("itemset", F.lit(1), F.size("itemset") - 1)
    left = sets.select(stem.alias("stem"), F.element_at("itemset", -1).alias("a"))
    right = left.select("stem", F.col("a").alias("b"))
    joined = left.join(right, "stem").where(F.col("a") < F.col("b"))
    grown = joined.select(F.concat("stem", F.array("a", "b")).alias("candidate"))
    subsets = F.transform(
        F.sequence(F.lit(1), F.size("candidate")),
        lambda drop: F.filter("candidate", lambda _, i: i != drop - 1),
    )
    looked_up = (
        grown.select("candidate", F.explode(subsets).alias("itemset"))
        .join(sets, "itemset")
        .groupBy("candidate")
        .agg(F.count("*").alias("hits"))
    )
    return looked_up.where(F.col("hits") == F.size("candidate")).select(F.col("candidate").alias("itemset"))


def _subsets(baskets: DataFrame, max_len: int) -> DataFrame:
    """Every subset of up to ``max_len`` items of every basket."""
    sets = F.transform("items", lambda x: F.array(x))
    rows = baskets.withColumn("__1", sets)
    for k in range(2, max_len + 1):
        grown = F.transform(
            f"__{k - 1}",
            lambda s: F.transform(
                F.filter("items", lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x))
            ),
        )
        rows = rows.withColumn(f"__{k}", F.flatten(grown))
    every = F.flatten(F.array(*[f"__{k}" for k in range(1, max_len + 1)]))
    return rows.select("w", F.explode(every).alias("itemset"))


def frequent_itemsets(
    tx: DataFrame,
    min_support: float = 0.05,
    max_len: int = 3,
    items: str = "items",
    weight: str | None = None,
    max_subsets: int = MAX_SUBSETS,
) -> DataFrame:
    """All itemsets of up to ``max_len`` items held by at least ``min_support``
    of the transactions, as ``(itemset, n_tx, support)``.

    ``items`` must be sorted arrays without repeats, as ``to_transactions`` and
    ``to_baskets`` make them; ``weight`` is the count column of the latter. Items
    that are not frequent alone leave the baskets first, and baskets that are then
    equal become one. If the subsets of what is left are few, in all (at most
    ``max_subsets``) and in each basket, one aggregate counts them. Otherwise
    mining goes level by level and a set is only counted when all of its subsets
    are frequent. The results are the same.
    """
    whole = materialise(distinct_baskets(tx, items, weight), "baskets")
    n = whole.agg(F.sum("w")).first()[0] or 0
    first = materialise(_level_one(whole, max(n, 1), min_support), "itemsets")
    baskets = _pruned(whole, first.select(F.col("itemset")[0].alias("item")))
    widths = baskets.groupBy(F.size("items").alias("m")).agg(F.count("*").alias("n")).collect()
    subsets = {r["m"]: sum(comb(r["m"], k) for k in range(1, max_len + 1)) for r in widths}
    total = sum(r["n"] * subsets[r["m"]] for r in widths)
    if total <= max_subsets and max(subsets.values(), default=0) <= MAX_BASKET_SUBSETS:
        counts = _subsets(baskets, max_len).groupBy("itemset").agg(F.sum("w").alias("n_tx"))
        return materialise(_frequent(counts, max(n, 1), min_support), "itemsets")
    return _by_level(baskets, first, n, min_support, max_len)


def _pruned(baskets: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct baskets of the known items alone, numbered."""
    cells = baskets.select(F.monotonically_increasing_id().alias("id"), "w", "items")
    cells = materialise(cells, "baskets").select("id", "w", F.explode("items").alias("item"))
    kept = cells.join(known, "item", "left_semi").groupBy("id").agg(F.first("w").alias("w"), F.sort_array(F.collect_list("item")).alias("items"))
    equal = kept.groupBy("items").agg(F.sum("w").alias("w"))
    return materialise(equal.select(F.monotonically_increasing_id().alias("id"), "items", "w"), "baskets")


def _by_level(baskets: DataFrame, first: DataFrame, n: int, min_support: float, max_len: int) -> DataFrame:
    """Level by level: the frequent sets that each basket holds, one row each, join
    the basket's items beyond their last one; sets that are no candidates go by
    semi-join before counting. Levels and held sets are written, so that a level
    costs its own joins alone and Spark knows sizes when it plans them."""
    cells = materialise(baskets.select("id", "w", F.explode("items").alias("item")), "cells")
    held = cells.select("id", "w", F.array("item").alias("itemset"), F.col("item").alias("last"))
    level = found = first
    for size in range(2, max_len + 1):
        if level.isEmpty():
            break
        more = cells.select("id", "item")
        grown = held.join(more, "id").where(F.col("item") > F.col("last"))
        grown = grown.select("id", "w", F.concat("itemset", F.array("item")).alias("itemset"), F.col("item").alias("last"))
        if size > 2:  # of two items, both frequent is all there is to check
            grown = grown.join(materialise(candidate_sets(level), "candidates"), "itemset", "left_semi")
        counts = grown.groupBy("itemset").agg(F.sum("w").alias("n_tx"))
        level = materialise(_frequent(counts, n, min_support), "itemsets")
        if size < max_len:
            held = materialise(grown.join(level.select("itemset"), "itemset", "left_semi").select("id", "w", "itemset", "last"), "held")
        found = found.unionByName(level)
    return found


def _largest_above(frequent: DataFrame) -> DataFrame:
    """(itemset, above): the most transactions of a set with one item more. A set of
    any size has its support if the closest ones have none of theirs equal, so one level
    up decides."""
    subsets = F.transform(F.sequence(F.lit(1), F.size("itemset")), lambda drop: F.filter("itemset", lambda _, i: i != drop - 1))
    below = frequent.where(F.size("itemset") > 1).select("n_tx", F.explode(subsets).alias("itemset"))
    return below.groupBy("itemset").agg(F.max("n_tx").alias("above"))


def closed_itemsets(frequent: DataFrame) -> DataFrame:
    """The frequent sets of which no larger frequent set has the same support. Sets of the
    longest length mined count as closed."""
    joined = frequent.join(_largest_above(frequent), "itemset", "left")
    return joined.where(F.col("above").isNull() | (F.col("above") < F.col("n_tx"))).drop("above")


def maximal_itemsets(frequent: DataFrame) -> DataFrame:
    """The frequent sets that no larger frequent set holds."""
    return frequent.join(_largest_above(frequent), "itemset", "left_anti")


def itemsets_of_closed(closed: DataFrame) -> DataFrame:
    """All frequent sets again, with their supports: a set has the support of its smallest
    closure, the largest among the closed sets that hold it."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("itemset")).cast("int") - 1)
    parts = closed.select("itemset", "n_tx", "support", F.explode(masks).alias("mask"))
    subset = F.filter("itemset", lambda _, i: F.getbit(F.col("mask"), i) == 1)
    return parts.groupBy(subset.alias("itemset")).agg(F.max("n_tx").alias("n_tx"), F.max("support").alias("support"))


def association_rules(frequent: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Every split of every frequent set into antecedent and consequent with at
    least ``min_confidence``. Text columns join the sorted items by comma; the
    array columns hold the same items."""
    size = F.size("itemset")
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 2)

    def side(bit: int) -> Column:
        return F.filter("itemset", lambda _, i: F.getbit(F.col("mask"), i) == bit)

    splits = (
        frequent.where(size >= 2)
        .select("itemset", "support", F.explode(masks).alias("mask"))
        .select("support", side(1).alias("antecedent_items"), side(0).alias("consequent_items"))
    )
    of_ante = frequent.select(F.col("itemset").alias("antecedent_items"), F.col("support").alias("__ante"))
    of_cons = frequent.select(F.col("itemset").alias("consequent_items"), F.col("support").alias("__cons"))
    confident = (
        splits.join(of_ante, "antecedent_items")
        .withColumn("confidence", F.col("support") / F.col("__ante"))
        .where(F.col("confidence") >= min_confidence)
    )
    return confident.join(of_cons, "consequent_items").select(
        F.array_join("antecedent_items", ", ").alias("antecedent"),
        F.array_join("consequent_items", ", ").alias("consequent"),
        "support",
        "confidence",
        (F.col("confidence") / F.col("__cons")).alias("lift"),
        "antecedent_items",
        "consequent_items",
    )


def by_lift(rules: DataFrame) -> DataFrame:
    """Highest lift first; equal lifts by antecedent, then consequent."""
    return rules.orderBy(F.desc("lift"), "antecedent", "consequent")


def top_rules(rules: DataFrame, n: int = 15) -> DataFrame:
    return by_lift(rules).limit(n)


def rules_for_prefix(rules: DataFrame, prefix: str) -> DataFrame:
    """Rules whose joined consequent text starts with ``prefix``. The test is on
    the text: with prefix ``B=``, consequent ``B=x, C=y`` passes and
    ``A=z, B=x`` does not."""
    return rules.where(F.col("consequent").startswith(prefix))


def rules_for_consequents(rules: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rules whose whole consequent text is one of ``values``, by lift."""
    return by_lift(rules.where(F.col("consequent").isin(*values)))


def rare_rules(
    tx: DataFrame,
    targets: Sequence[str],
    min_support: float = 0.006,
    min_confidence: float = 0.2,
    max_len: int = 4,
    weight: str | None = None,
) -> DataFrame:
    """Rules that end in one of a few rare items: low thresholds, longer sets."""
    frequent = frequent_itemsets(tx, min_support, max_len, weight=weight)
    return rules_for_consequents(association_rules(frequent, min_confidence), targets)


def common_and_rare_rules(
    tx: DataFrame,
    prefix: str,
    targets: Sequence[str],
    common: tuple[float, float, int] = (0.02, 0.4, 3),
    rare: tuple[float, float, int] = (0.006, 0.2, 4),
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rules for consequents with ``prefix``, and rules for the rare ``targets``,
    each under its own (support, confidence, length). Both come from one mining
    pass at the looser thresholds: a set's support does not depend on them."""
    frequent = frequent_itemsets(tx, min(common[0], rare[0]), max(common[2], rare[2]), weight=weight)

    def rules(support: float, confidence: float, length: int) -> DataFrame:
        kept = frequent.where((F.col("support") >= support) & (F.size("itemset") <= length))
        return association_rules(kept, confidence)

    return by_lift(rules_for_prefix(rules(*common), prefix)), rules_for_consequents(rules(*rare), targets)


def mine_conditions(
    df: DataFrame,
    rules: Sequence[ItemRule],
    min_support: float = 0.03,
    min_confidence: float = 0.5,
    max_len: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Table to items to transactions to itemsets to rules."""
    baskets = to_baskets(discretize(df, rules), [r.attr for r in rules])
    frequent = frequent_itemsets(baskets, min_support, max_len, weight="w")
    return frequent, by_lift(association_rules(frequent, min_confidence))
