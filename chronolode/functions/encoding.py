"""Encoding and discretisation as pure column expressions.

Nothing here shuffles except the two functions that must look at the whole
column first: ``one_hot`` without given levels and ``cut_quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.functions.quantiles import quantile_edges

MAX_LEVELS = 1000


def category_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """The sorted distinct values of a column. A column with more than
    ``max_levels`` of them is an error: each level becomes one output column."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col!r} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def one_hot(
    df: DataFrame, col: str, prefix: str, levels: Sequence | None = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Replace ``col`` by one 0/1 column per level, in sorted level order and
    placed last. All levels are kept; a null gives zero everywhere."""
    levels = category_levels(df, col, max_levels) if levels is None else sorted(levels)
    flags = [F.col(col).eqNullSafe(F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in levels]
    return df.select(*[c for c in df.columns if c != col], *flags)


def band(value: Column, edges: Sequence[float], labels: Sequence[str], lowest_included: bool = False) -> Column:
    """Label of the right-closed interval ``(lo, hi]`` that holds the value.
    Values outside all intervals, and nulls, give null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one edge more than labels")
    if any(lo >= hi for lo, hi in pairwise(edges)):
        raise ValueError("edges must grow strictly")
    low = F.lit(float(edges[0]))
    chain = F.when(value < low if lowest_included else value <= low, F.lit(None).cast("string"))
    for hi, label in zip(edges[1:], labels):
        chain = chain.when(value <= F.lit(float(hi)), F.lit(label))
    return chain


def cut_bands(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str | None = None) -> DataFrame:
    """Fixed right-closed bands; the last edge may be ``float('inf')``."""
    return df.withColumn(out or f"{col}_band", band(F.col(col), edges, labels))


def merge_duplicate_edges(edges: Sequence[float], labels: Sequence[str], on_duplicate: str) -> tuple[list, list]:
    """Equal neighbouring edges are an error, or with ``merge`` the empty bands
    between them go."""
    if on_duplicate not in ("raise", "merge"):
        raise ValueError(f"unknown on_duplicate {on_duplicate!r}")
    kept, names = [edges[0]], []
    for (lo, hi), label in zip(pairwise(edges), labels):
        if hi == lo:
            if on_duplicate == "raise":
                raise ValueError(f"bin edges must be unique: {list(edges)}")
            continue
        kept.append(hi)
        names.append(label)
    return kept, names


def cut_quantiles(
    df: DataFrame,
    cols: Mapping[str, str],
    labels: Sequence[str] = ("Low", "Med", "High"),
    on_duplicate: str = "raise",
) -> DataFrame:
    """Quantile bands for several columns at once (``{col: out}``): edges are
    the exact linear quantiles over the whole table, ties stay together and the
    lowest value is included."""
    q = len(labels)
    probs = [i / q for i in range(q + 1)]
    found = quantile_edges(df, list(cols), probs)
    added = {}
    for col, out in cols.items():
        if any(e is None for e in found[col]):
            added[out] = F.lit(None).cast("string")
            continue
        edges, names = merge_duplicate_edges(found[col], labels, on_duplicate)
        added[out] = band(F.col(col), edges, names, lowest_included=True)
    return df.withColumns(added)


def map_values(value: Column, mapping: Mapping) -> Column:
    """Value of a small dictionary; unmapped gives null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


# Month number -> season.
SEASONS = {
    1: "Winter",
    2: "Winter",
    3: "Spring",
    4: "Spring",
    5: "Spring",
    6: "Summer",
    7: "Summer",
    8: "Summer",
    9: "Autumn",
    10: "Autumn",
    11: "Autumn",
    12: "Winter",
}


def bucket_hours(hour: Column) -> Column:
    """Part of the day; any hour outside the three spans, null too, is Night."""
    # Start (included) and end (excluded) of each part of the day.
    spans = (("Morning", 5, 11), ("Afternoon", 11, 17), ("Evening", 17, 22))
    name, lo, hi = spans[0]
    chain = F.when((hour >= lo) & (hour < hi), name)
    for name, lo, hi in spans[1:]:
        chain = chain.when((hour >= lo) & (hour < hi), name)
    return chain.otherwise("Night")


def flag_positive(value: Column, yes: str = "Yes", no: str = "No") -> Column:
    """``yes`` where the value is above zero, else ``no``; null is ``no``."""
    return F.when(value > 0, yes).otherwise(no)


def as_item(value: Column, attr: str) -> Column:
    """``ATTR=value`` text; a null stays null and yields no item."""
    return F.concat(F.lit(f"{attr}="), value.cast("string"))


@dataclass(frozen=True)
class Bands:
    """Item from fixed bands."""

    attr: str
    col: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Quantiles:
    """Item from equal-share bands of the whole column."""

    attr: str
    col: str
    labels: tuple[str, ...] = ("Low", "Med", "High")


@dataclass(frozen=True)
class Category:
    """Item from the value itself."""

    attr: str
    col: str


@dataclass(frozen=True)
class Mapped:
    """Item from a small dictionary, e.g. month to season."""

    attr: str
    col: str
    mapping: Mapping = field(default_factory=lambda: SEASONS, hash=False)


@dataclass(frozen=True)
class HourOfDay:
    """Item from the part of the day."""

    attr: str
    col: str


@dataclass(frozen=True)
class Positive:
    """Item from a greater-than-zero test."""

    attr: str
    col: str


ItemRule = Bands | Quantiles | Category | Mapped | HourOfDay | Positive


def discretize(df: DataFrame, rules: Sequence[ItemRule], keep: Sequence[str] = ()) -> DataFrame:
    """One ``ATTR=value`` column per rule, named after its attribute, next to
    the columns in ``keep``. All quantile rules share one pass for their edges; rules
    without quantiles look at one row only and work on a stream as well."""
    by_quantile = [r for r in rules if isinstance(r, Quantiles)]
    edges: dict[tuple[str, int], list] = {}
    for q in {len(r.labels) for r in by_quantile}:
        cols = list({r.col: None for r in by_quantile if len(r.labels) == q})
        for col, found in quantile_edges(df, cols, [i / q for i in range(q + 1)]).items():
            edges[col, q] = found

    def item(rule: ItemRule) -> Column:
        value = F.col(rule.col)
        match rule:
            case Bands():
                value = band(value, rule.edges, rule.labels)
            case Quantiles():
                cuts = edges[rule.col, len(rule.labels)]
                if any(e is None for e in cuts):
                    value = F.lit(None).cast("string")
                else:
                    cuts, names = merge_duplicate_edges(cuts, rule.labels, "raise")
                    value = band(value, cuts, names, lowest_included=True)
            case Mapped():
                value = map_values(value, rule.mapping)
            case HourOfDay():
                value = bucket_hours(value)
            case Positive():
                value = flag_positive(value)
        return as_item(value, rule.attr).alias(rule.attr)

    return df.select(*keep, *[item(r) for r in rules])


def to_transactions(df: DataFrame, item_cols: Sequence[str], tx_id: str | None = None) -> DataFrame:
    """Sorted array of the distinct non-null items of each row. A row can never
    hold more items than there are item columns."""
    return df.select(*([tx_id] if tx_id else []), _items(item_cols))


def _items(item_cols: Sequence[str]) -> Column:
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*item_cols)))).alias("items")


def to_baskets(df: DataFrame, item_cols: Sequence[str]) -> DataFrame:
    """Distinct transactions with the number ``w`` of rows that have each. Rows
    are combined by their item columns before any array is built."""
    counted = df.groupBy(*item_cols).agg(F.count("*").alias("w"))
    return counted.select(_items(item_cols), "w")


def wide_transactions(df: DataFrame, tx_id: str, vocabulary: Sequence[str]) -> DataFrame:
    """Boolean one-column-per-item form of ``to_transactions`` output."""
    return df.select(tx_id, *[F.array_contains("items", v).alias(v) for v in vocabulary])
