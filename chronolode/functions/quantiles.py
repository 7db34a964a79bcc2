"""Exact linear quantiles that do not gather a column or group in one task.

Two ways, chosen by measured size, with the same result:

* up to ``max_rows`` values: Spark's ``percentile``;
* otherwise a first pass over the rows merges quantile sketches, which bracket every
  wanted rank, and a second counts the rows between brackets and the values inside,
  with map-side combine. The counts decide, so the result is exact however far off
  a sketch is. Where a rank lies outside its bracket, or a bracket has more values
  than one task should sort, its range is narrowed further by counting rows per
  equal-width cell. A cell that holds one value, however often, is an answer. All
  groups are narrowed in the same passes; their ranges are a table, and rows outside
  the ranges still open are left behind.

On both ways NaN is no value, and infinite values rank at the ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.sources.scratch import materialise

MAX_ROWS = 1_000_000
_CELLS = 4096
#: Size of a sketch, and the share of all rows by which a bracket exceeds its rank on
#: either side, twice the error that sketches of this size keep to in 99 of 100 cases.
_SKETCH, _MARGIN = 2048, 0.003
#: Ranges sent to every executor; more of them join by a shuffle.
_BROADCAST_RANGES = 50_000
#: Brackets whose ends a row is compared with one by one; those of more are searched.
_COMPARED = 16


def _probs(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def _value(col: str) -> Column:
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v)


def quantile_edges(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], max_rows: int = MAX_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles of each column at each probability; all None when the column
    holds no value."""
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not cols:
        return found
    table = df.select(*[_value(c).alias(f"v{i}") for i, c in enumerate(cols)])
    counts = table.agg(*[F.count(f"v{i}") for i in range(len(cols))]).first()
    small = [i for i, n in enumerate(counts) if 0 < n <= max_rows]
    if small:
        row = table.agg(*[F.percentile(f"v{i}", _probs(probs)).alias(f"q{i}") for i in small]).first()
        found |= {cols[i]: list(row[f"q{i}"]) for i in small}
    large = [i for i, n in enumerate(counts) if n > max_rows]
    if large:
        pairs = F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"v{i}").alias("v")) for i in large])
        rows = table.select(F.explode(pairs).alias("p")).select("p.g", "p.v").where(F.col("v").isNotNull())
        found |= {cols[r["g"]]: list(r["q"]) for r in _by_sketches(rows, probs, max_rows).collect()}
    return found


def _by_sketches(rows: DataFrame, probs: Sequence[float], max_rows: int) -> DataFrame:
    """(g, n, q) of all groups of (g, v)."""
    finite = F.when(F.abs("v") < F.lit(float("inf")), F.col("v"))
    sketched = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") == F.lit(float("-inf"))).alias("low"),
        F.count(finite).alias("inner"),
        F.kll_sketch_agg_double("v", _SKETCH).alias("sketch"),
    )

    def edge(shift: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", _probs([min(max(p + shift, 0.0), 1.0) for p in probs]))

    groups = sketched.select("g", "n", "low", "inner", edge(-_MARGIN).alias("from"), edge(_MARGIN).alias("to"))
    groups = materialise(groups, "groups")
    places = F.transform(_probs(probs), lambda p: (F.col("n") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x)), F.transform(places, lambda x: F.ceil(x))))
    ranked = groups.select("g", "low", "inner", F.explode(ranks).alias("rank"))
    end = F.when(F.col("rank") < F.col("low"), F.lit(float("-inf"))).when(
        F.col("rank") >= F.col("low") + F.col("inner"), F.lit(float("inf"))
    )
    done = ranked.withColumn("v", end).where(F.col("v").isNotNull()).select("g", "rank", "v")
    wanted = ranked.where(end.isNull()).groupBy("g").agg(F.first("low").alias("low"), F.collect_list("rank").alias("ranks"))

    rows = rows.where(F.abs("v") < F.lit(float("inf")))
    counted = materialise(_bracketed(rows, groups, len(probs)), "bracketed")
    ranges = materialise(_cells_with_ranks(counted, wanted), "ranges")
    one = F.col("lo") == F.col("hi")
    done = done.unionByName(ranges.where(one).select("g", F.explode("ranks").alias("rank"), F.col("lo").alias("v")))
    few = F.col("inside") & (F.col("values") <= max_rows)
    listed = ranges.where(~one & few).select("g", "cell", "below", "ranks")
    done = done.unionByName(_picked(counted.select("g", "cell", "v", "w").join(listed, ["g", "cell"])))
    left = ranges.where(~one & ~few).select("g", "lo", "hi", "below", "rows", "ranks")
    if not left.isEmpty():
        done = done.unionByName(_narrowed_down(rows, left, max_rows))
    at = done.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def between(place: Column) -> Column:
        lo, hi, part = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)], place - F.floor(place)
        return F.when((part == 0) | (lo == hi), lo).otherwise((1 - part) * lo + part * hi)

    return groups.join(at, "g").select("g", "n", F.transform(places, between).alias("q"))


def _bracketed(rows: DataFrame, groups: DataFrame, brackets: int) -> DataFrame:
    """Rows counted by cell, and inside brackets by value: (g, cell, v, w, lo, hi). The ends
    of brackets and the gaps between them are cells, numbered in their order."""
    edges = groups.select("g", F.sort_array("from").alias("from"), F.sort_array("to").alias("to"))
    edges = F.broadcast(edges) if groups.count() <= _BROADCAST_RANGES else edges
    if brackets <= _COMPARED:
        cell, inside = F.lit(0), F.lit(False)
        for i in range(brackets):
            for e in (F.col("from")[i], F.col("to")[i]):
                cell = cell + (F.col("v") >= e).cast("int") + (F.col("v") > e).cast("int")
            inside = inside | F.col("v").between(F.col("from")[i], F.col("to")[i])
    else:
        upto, below = _ends_passed(brackets, True), _ends_passed(brackets, False)
        cell = upto("from") + below("from") + upto("to") + below("to")
        inside = upto("from") > below("to")
    placed = rows.join(edges, "g").select("g", cell.alias("cell"), F.when(inside, F.col("v")).alias("value"), "v")
    counted = placed.groupBy("g", "cell", "value").agg(F.count("*").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return counted.withColumnRenamed("value", "v")


def _ends_passed(brackets: int, equal: bool) -> Callable[[str], Column]:
    """The number of ends, in a sorted array of so many, below ``v`` or up to it, by halving:
    the expression does not grow with the ends."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(brackets.bit_length()))])

    def count(ends: str) -> Column:
        def on(at: Column, step: Column) -> Column:
            end = F.get(F.col(ends), at + step - 1)  # null: there are not so many
            return F.when(end <= F.col("v") if equal else end < F.col("v"), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), on)

    return count


def _cells_with_ranks(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells that hold a wanted rank, as ranges."""
    cells = counted.groupBy("g", "cell").agg(
        F.sum("w").alias("rows"), F.count("v").alias("values"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(wanted, "g")
    below = F.col("low") + F.col("before")
    held = F.filter("ranks", lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("rows")))
    kept = placed.withColumn("below", below).withColumn("ranks", held).where(F.size("ranks") > 0)
    return kept.select("g", "cell", "lo", "hi", "below", "rows", "values", (F.col("values") > 0).alias("inside"), "ranks")


def _narrowed_down(rows: DataFrame, ranges: DataFrame, max_rows: int) -> DataFrame:
    """(g, rank, v) of the ranks of (g, lo, hi, below, rows, ranks)."""
    done = ranges.limit(0).select("g", F.lit(0).cast("long").alias("rank"), "lo").withColumnRenamed("lo", "v")
    while True:
        one = F.col("lo") == F.col("hi")
        done = done.unionByName(ranges.where(one).select("g", F.explode("ranks").alias("rank"), F.col("lo").alias("v")))
        open_ = ranges.where(~one)
        left, most = open_.agg(F.count("*"), F.max("rows")).first()
        if not left:
            return done
        rows = materialise(_held(rows, open_, left).select("g", "v"), "open-rows")
        held = _held(rows, open_, left)
        if most <= max_rows:
            counted = held.groupBy("g", "below", "v").agg(F.count("*").alias("w"), F.first("ranks").alias("ranks"))
            return done.unionByName(_picked(counted))
        ranges = materialise(_narrowed(held), "ranges")


def _held(rows: DataFrame, ranges: DataFrame, count: int) -> DataFrame:
    """Rows with the range that holds their value."""
    ranges = F.broadcast(ranges) if count <= _BROADCAST_RANGES else ranges
    return rows.join(ranges, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))


def _narrowed(held: DataFrame) -> DataFrame:
    """The cells of every range that hold a wanted rank, as ranges."""
    # halves, as the whole width of a range may exceed the largest number
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    cell = F.least(F.floor(share * _CELLS), F.lit(_CELLS - 1))
    cells = held.groupBy("g", "below", cell.alias("cell")).agg(
        F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("ranks").alias("ranks")
    )
    before = Window.partitionBy("g", "below").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("from", F.col("below") + F.coalesce(F.sum("rows").over(before), F.lit(0)))
    wanted = F.filter("ranks", lambda k: (k >= F.col("from")) & (k < F.col("from") + F.col("rows")))
    kept = placed.withColumn("ranks", wanted).where(F.size("ranks") > 0)
    return kept.select("g", "lo", "hi", F.col("from").alias("below"), "rows", "ranks")


def _picked(counted: DataFrame) -> DataFrame:
    """Ranks inside ranges of few values: a running count over the values (g, below, v, w, ranks)."""
    upto = F.sum("w").over(Window.partitionBy("g", "below").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", F.col("below") + upto)
    hit = F.filter("ranks", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("w")))
    return placed.select("g", F.explode(hit).alias("rank"), "v")


def quantile(df: DataFrame, col: str, p: float, max_rows: int = MAX_ROWS) -> float | None:
    """A single exact quantile."""
    return quantile_edges(df, [col], [p], max_rows)[col][0]


def grouped_quantiles(
    df: DataFrame, key: str, col: str, probs: Sequence[float], max_rows: int = MAX_ROWS
) -> DataFrame:
    """Quantiles per group as ``(key, n, q array<double>)``. Groups of more than
    ``max_rows`` values are narrowed together, the others take one aggregate."""
    kept = df.select(F.col(key).alias("g"), _value(col).alias("v")).where(F.col("v").isNotNull() & F.col("g").isNotNull())
    sizes = materialise(kept.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > max_rows)
    rest = kept.join(large, "g", "left_anti")
    out = rest.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", _probs(probs)).alias("q"))
    if not large.isEmpty():
        out = out.unionByName(_by_sketches(kept.join(large.select("g"), "g", "left_semi"), probs, max_rows))
    return out.withColumnRenamed("g", key)
