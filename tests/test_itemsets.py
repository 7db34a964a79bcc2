from itertools import chain, combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolode.operators.itemsets import (
    association_rules,
    candidate_sets,
    closed_itemsets,
    frequent_itemsets,
    item_support,
    itemsets_of_closed,
    maximal_itemsets,
    rare_rules,
    rules_for_consequents,
    rules_for_prefix,
    top_rules,
)
from chronolode.operators.vertical import _block_size, itemsets_by_bitmaps

SCHEMA = "items array<string>"


def table(spark, baskets):
    return spark.createDataFrame([(sorted(set(b)),) for b in baskets], SCHEMA)


def brute_force(baskets, min_support, max_len):
    n = len(baskets)
    items = sorted(set(chain.from_iterable(baskets)))
    found = {}
    for k in range(1, max_len + 1):
        for c in combinations(items, k):
            share = sum(set(c) <= set(b) for b in baskets) / n
            if share >= min_support:
                found[c] = share
    return found


def as_dict(df):
    return {tuple(r["itemset"]): r["support"] for r in df.collect()}


@settings(max_examples=8, deadline=None)
@given(
    baskets=st.lists(st.sets(st.sampled_from("abcdefg"), max_size=7), min_size=1, max_size=40),
    min_support=st.sampled_from([0.05, 0.2, 0.5]),
    max_subsets=st.sampled_from([0, 10_000]),
)
def test_itemsets_equal_brute_force(spark, baskets, min_support, max_subsets):
    got = as_dict(frequent_itemsets(table(spark, baskets), min_support, 4, max_subsets=max_subsets))
    assert got == brute_force(baskets, min_support, 4)


def test_hot_basket_is_one_row_after_the_first_aggregate(spark):
    baskets = [["a", "b"]] * 500 + [["a", "c"]] * 3
    for max_subsets in (0, 1000):
        got = as_dict(frequent_itemsets(table(spark, baskets), 0.001, 3, max_subsets=max_subsets))
        assert got == brute_force(baskets, 0.001, 3)


def test_empty_results(spark):
    for max_subsets in (0, 1000):
        none = frequent_itemsets(table(spark, [["a"], ["b"], ["c"]]), 0.9, max_subsets=max_subsets)
        assert none.count() == 0
        assert association_rules(none).count() == 0
        empty = frequent_itemsets(spark.createDataFrame([], SCHEMA), 0.1, max_subsets=max_subsets)
        assert empty.count() == 0


def test_candidates_need_all_subsets(spark):
    pairs = [["a", "b"], ["a", "c"], ["b", "c"], ["b", "d"], ["a", "d"]]
    df = spark.createDataFrame([(p,) for p in pairs], "itemset array<string>")
    got = sorted(r["itemset"] for r in candidate_sets(df).collect())
    assert got == [["a", "b", "c"], ["a", "b", "d"]]


BASKETS = [["A", "B", "C"]] * 6 + [["A"]] * 2 + [["B", "C"]] * 1 + [["D"]] * 3


def test_every_split_is_a_rule(spark):
    frequent = frequent_itemsets(table(spark, BASKETS), 0.3, 3)
    rules = association_rules(frequent, 0.0).collect()
    of_three = {(r["antecedent"], r["consequent"]) for r in rules if len(r["antecedent_items"] + r["consequent_items"]) == 3}
    assert of_three == {
        ("A", "B, C"), ("B", "A, C"), ("C", "A, B"), ("A, B", "C"), ("A, C", "B"), ("B, C", "A"),
    }
    by_name = {(r["antecedent"], r["consequent"]): r for r in rules}
    rule = by_name["A", "B, C"]
    assert (rule["support"], rule["confidence"]) == (0.5, 0.75)
    assert rule["lift"] == pytest.approx(0.75 / (7 / 12))
    for (a, c), r in by_name.items():
        assert r["confidence"] <= 1
        assert r["lift"] == pytest.approx(by_name[c, a]["lift"])


def test_confidence_is_a_lower_bound(spark):
    frequent = frequent_itemsets(table(spark, BASKETS), 0.3, 3)
    kept = association_rules(frequent, 0.8)
    assert kept.where("confidence < 0.8").isEmpty() and not kept.isEmpty()


def test_prefix_looks_at_the_joined_text(spark):
    rows = [("x", "P=Good, R=No", 2.0), ("y", "D=Low, P=Good", 3.0), ("z", "P=Bad", 1.0)]
    rules = spark.createDataFrame(rows, "antecedent string, consequent string, lift double")
    assert {r["antecedent"] for r in rules_for_prefix(rules, "P=").collect()} == {"x", "z"}
    assert [r["antecedent"] for r in rules_for_consequents(rules, ["P=Bad", "P=Good"]).collect()] == ["z"]
    assert [r["antecedent"] for r in top_rules(rules, 2).collect()] == ["y", "x"]


def test_rare_rules_end_in_a_target(spark):
    got = rare_rules(table(spark, BASKETS), ["B"], 0.05, 0.1, 3).collect()
    assert got and all(r["consequent"] == "B" for r in got)
    assert [r["lift"] for r in got] == sorted((r["lift"] for r in got), reverse=True)


def test_item_support(spark):
    got = {r["item"]: (r["n_tx"], r["support"]) for r in item_support(table(spark, BASKETS), 0.5).collect()}
    assert got == {"A": (8, 8 / 12), "B": (7, 7 / 12), "C": (7, 7 / 12)}


def test_wide_baskets_stay_exact(spark):
    wide = [[f"i{j:02d}" for j in range(30)]] * 2 + [["i00", "i29"], ["zz"]]
    got = frequent_itemsets(table(spark, wide), 0.7, 3, max_subsets=100)
    assert as_dict(got) == {("i00",): 0.75, ("i29",): 0.75, ("i00", "i29"): 0.75}
    assert got.where(F.size("itemset") > 2).isEmpty()


def test_very_wide_baskets(spark):
    """Few of a thousand items are frequent; no basket may be expanded as it is."""
    baskets = [[f"f{j:02d}" for j in range(20) if (i + j) % 10] + [f"r{i:02d}x{j:04d}" for j in range(980)] for i in range(50)]
    common = [[x for x in b if x[0] == "f"] for b in baskets]
    got = as_dict(frequent_itemsets(table(spark, baskets), 0.5, 3))
    assert got == brute_force(common, 0.5, 3)
    assert as_dict(frequent_itemsets(table(spark, baskets), 0.5, 3, max_subsets=0)) == got


def test_one_wide_basket_goes_level_by_level(spark):
    baskets = [[f"i{j:03d}" for j in range(200)]] * 3 + [["i000", "i001"]] * 97
    got = frequent_itemsets(table(spark, baskets), 0.5, 3)
    assert as_dict(got) == {("i000",): 1.0, ("i001",): 1.0, ("i000", "i001"): 1.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6), min_size=1, max_size=25))
def test_closed_and_maximal_sets(spark, baskets):
    """By their definitions, and closed sets give back all frequent ones."""
    frequent = frequent_itemsets(table(spark, baskets), 0.2, 6).cache()
    counts = {frozenset(r["itemset"]): r["n_tx"] for r in frequent.collect()}
    above = {s: [t for t in counts if s < t] for s in counts}
    closed = {s for s in counts if all(counts[t] < counts[s] for t in above[s])}
    assert {frozenset(r["itemset"]) for r in closed_itemsets(frequent).collect()} == closed
    assert {frozenset(r["itemset"]) for r in maximal_itemsets(frequent).collect()} == {s for s in counts if not above[s]}
    again = itemsets_of_closed(closed_itemsets(frequent))
    assert {frozenset(r["itemset"]): (r["n_tx"], r["support"]) for r in again.collect()} == {
        frozenset(r["itemset"]): (r["n_tx"], r["support"]) for r in frequent.collect()
    }
    rules = association_rules(frequent, 0.3).select("antecedent", "consequent", "confidence")
    assert sorted(association_rules(again, 0.3).select(rules.columns).collect()) == sorted(rules.collect())


def test_no_set_is_closed_where_none_is_frequent(spark):
    none = frequent_itemsets(table(spark, [["a"], ["b"]]), 0.9, 3)
    assert closed_itemsets(none).collect() == maximal_itemsets(none).collect() == []


@settings(max_examples=6, deadline=None)
@given(
    baskets=st.lists(st.sets(st.sampled_from("abcdefg"), max_size=7), min_size=1, max_size=200),
    min_support=st.sampled_from([0.05, 0.2]),
    at_once=st.sampled_from([3, 10_000]),
    block=st.sampled_from([64, None]),
)
def test_itemsets_by_bitmaps_equal_brute_force(spark, baskets, min_support, at_once, block):
    got = as_dict(itemsets_by_bitmaps(table(spark, baskets), min_support, 5, at_once=at_once, block=block))
    assert got == brute_force(baskets, min_support, 5)


def test_bitmaps_over_many_blocks_with_weights(spark):
    """Some 2,000 distinct baskets in blocks of 64, weights of up to 40 digits."""
    rows = [(sorted({f"i{j}" for j in range(11) if i >> j & 1}), (i * 2654435761) % (1 << (i % 41))) for i in range(2048)]
    tx = spark.createDataFrame(rows, "items array<string>, w long").repartition(3)
    a = itemsets_by_bitmaps(tx, 0.1, 4, weight="w", at_once=50, block=64)
    b = frequent_itemsets(tx, 0.1, 4, weight="w")
    rows_of = lambda df: sorted((tuple(r["itemset"]), r["n_tx"]) for r in df.collect())
    assert rows_of(a) == rows_of(b) and any(len(s) == 4 for s, _ in rows_of(a))


def test_bitmaps_without_rows_pairs_or_frequent_sets(spark):
    for baskets, support in (([], 0.1), ([[]], 0.1), ([["a"], ["b"], ["c"]], 0.9), ([["a"], ["b"]], 0.1)):
        got = as_dict(itemsets_by_bitmaps(table(spark, baskets), support, 3))
        assert got == (brute_force(baskets, support, 3) if baskets else {})
    assert set(as_dict(itemsets_by_bitmaps(table(spark, [["a", "b"]] * 3), 0.5, 1))) == {("a",), ("b",)}


def test_blocks_shrink_with_the_items():
    assert _block_size(10) == 1 << 15 and _block_size(1 << 20) == 512 and _block_size(1 << 30) == 64
