"""Time order, positions, splits and folds.

A ``TimeOrder`` says how rows are ordered and which columns separate series.
Windows over a whole series put that series in one task, so ``prepare_series``
first measures the longest one. Short series get plain windows. Longer ones get
stored positions, and from then on every window runs over blocks of
``block_rows`` positions with a few neighbour rows copied in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronolode.sources.scratch import materialise

MAX_SERIES_ROWS = 1_000_000
#: Rows of a table that is sent to every executor; larger ones join by a shuffle.
MAX_BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class TimeOrder:
    """Row order of a table: by ``ts``, then ``ties``, within ``keys``. The
    columns ``keys + ts + ties`` together must be unique, ``keys`` and ``ts`` not
    null. ``pos`` and ``block_rows`` are set by ``prepare_series``."""

    ts: str
    ties: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    pos: str | None = None
    block_rows: int | None = None

    @property
    def sort_cols(self) -> list[str]:
        return [self.ts, *self.ties]

    @property
    def all_cols(self) -> list[str]:
        return [*self.keys, *self.sort_cols]

    def window(self, descending: bool = False) -> WindowSpec:
        cols = [F.col(c).desc() if descending else F.col(c).asc() for c in self.sort_cols]
        return Window.partitionBy(*self.keys).orderBy(*cols)


def order_by_time(df: DataFrame, order: TimeOrder) -> DataFrame:
    """Global sort: a range shuffle, no single task."""
    return df.orderBy(*order.all_cols)


def series_sizes(df: DataFrame, order: TimeOrder) -> tuple[int, int, int]:
    """Rows of the table, number of series, rows of the longest one. Only the key
    columns are read, and counts are combined before the shuffle."""
    if not order.keys:
        rows = df.count()
        return rows, 1, rows
    sizes = df.groupBy(*order.keys).agg(F.count("*").alias("n"))
    row = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("series"), F.max("n").alias("longest")).first()
    return row["rows"] or 0, row["series"], row["longest"] or 0


def _reject_nulls(df: DataFrame, order: TimeOrder) -> DataFrame:
    """Rows without a time or key have no place in a series; meeting one is an
    error rather than a silent loss."""
    checked = {}
    for c in [*order.keys, order.ts]:
        field = df.schema[c]
        if field.nullable:
            fail = F.raise_error(F.lit(f"null in {c}")).cast(field.dataType)
            checked[c] = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(fail)
    return df.withColumns(checked) if checked else df


def with_position(
    df: DataFrame, order: TimeOrder, out: str = "pos", max_series_rows: int = MAX_SERIES_ROWS
) -> DataFrame:
    """Add the dense 0-based position of each row in its series."""
    rows, series, longest = series_sizes(df, order)
    if longest <= max_series_rows:
        placed = (F.row_number().over(order.window()) - 1).cast("long")
        return _reject_nulls(df, order).withColumn(out, placed)
    laid = _time_layout(df, order, rows, max_series_rows)
    runs = laid.groupBy("__part", *order.keys).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.sum("__n").over(
        Window.partitionBy(*order.keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One run per series and partition it touches: no more than series plus
    # partitions. Joined by both, a long series stays spread over partitions.
    starts = runs.select("__part", *order.keys, (F.col("__first") - F.coalesce(earlier, F.lit(0))).alias("__start"))
    if series + _parts(rows, max_series_rows) <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = laid.join(starts, ["__part", *order.keys])
    return placed.select(*df.columns, (F.col("__row") - F.col("__start")).cast("long").alias(out))


def _parts(rows: int, part_rows: int) -> int:
    return max(2, -(-rows // part_rows))


def _time_layout(df: DataFrame, order: TimeOrder, rows: int, part_rows: int) -> DataFrame:
    """The table sorted by (keys, order) over range partitions, with ``__part``
    and the row's place ``__row`` in it.

    It is written once: afterwards partition numbers are data, which a lost
    executor cannot change. Sorting spills, so large partitions are slow at worst.
    """
    parts = _parts(rows, part_rows)
    cols = [F.col(c) for c in order.all_cols]
    return materialise(
        _reject_nulls(df, order)
        .repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "time-order",
    )


def prepare_series(
    df: DataFrame, order: TimeOrder, max_series_rows: int = MAX_SERIES_ROWS
) -> tuple[DataFrame, TimeOrder]:
    """Measure the longest series and choose how windows will run. Returns the
    table and the order to hand to the series operators.

    For long series the table gains ``__pos``, a number over all rows in (keys,
    order) order; within a series it counts up by one, which is all that lags and
    gaps need. It is the row's place plus the sizes of earlier partitions, a
    table of one row per partition, which is written as it is read again with
    every scan of the layout."""
    rows, _, longest = series_sizes(df, order)
    if longest <= max_series_rows:
        return _reject_nulls(df, order), replace(order, pos=None, block_rows=None)
    laid = _time_layout(df, order, rows, max_series_rows)
    sizes = laid.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__earlier")), "offsets")
    if _parts(rows, max_series_rows) <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = laid.join(offsets, "__part").select(
        *df.columns, (F.col("__row") + F.col("__earlier")).cast("long").alias("__pos")
    )
    return placed, replace(order, pos="__pos", block_rows=max_series_rows)


def block_of(order: TimeOrder, shift: int = 0) -> Column:
    """Block number of the position ``shift`` rows further on."""
    if shift < 0:  # ``div`` rounds towards zero; keep its argument positive
        return F.expr(f"(`{order.pos}` + {order.block_rows + shift}) div {order.block_rows} - 1")
    return F.expr(f"(`{order.pos}` + {shift}) div {order.block_rows}")


def with_reach(order: TimeOrder, back: int, ahead: int) -> TimeOrder:
    """The order with blocks of at least ten times the rows that windows reach, so
    that copied rows stay few."""
    if order.block_rows is None:
        return order
    return replace(order, block_rows=max(order.block_rows, 10 * max(back, ahead)))


def spread_blocks(df: DataFrame, order: TimeOrder, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add ``__block``, and copy the last ``back`` rows of a block to the next one
    and the first ``ahead`` rows to the one before. ``__home`` is the block that a
    row belongs to."""
    size = order.block_rows
    if max(back, ahead) > size:
        raise ValueError(f"blocks of {size} rows cannot serve windows of {max(back, ahead)}")
    placed = df.withColumn("__home", block_of(order))
    if not back and not ahead:
        return placed.withColumn("__block", F.col("__home"))
    place = F.col(order.pos) % F.lit(size).cast("long")
    home = F.col("__home")
    copies = [home, F.when(place >= size - back, home + 1), F.when((place < ahead) & (home > 0), home - 1)]
    return placed.withColumn("__block", F.explode(F.array(*copies))).where(F.col("__block").isNotNull())


def block_window(order: TimeOrder, descending: bool = False) -> WindowSpec:
    pos = F.col(order.pos)
    return Window.partitionBy(*order.keys, "__block").orderBy(pos.desc() if descending else pos.asc())


def drop_copies(spread: DataFrame) -> DataFrame:
    return spread.where(F.col("__home") == F.col("__block")).drop("__home", "__block")


def over_series(
    df: DataFrame,
    order: TimeOrder,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Add window expressions that look at most ``back`` rows behind and
    ``ahead`` rows ahead. All of them share one exchange and one sort. With
    blocks, copied neighbour rows make every value equal that of the single
    window."""
    kept = [c for c in df.columns if c not in exprs]

    def added(rows: DataFrame, w: WindowSpec) -> DataFrame:
        helpers = [c for c in ("__home", "__block") if c in rows.columns]
        return rows.select(*kept, *helpers, *[f(w).alias(name) for name, f in exprs.items()])

    if order.block_rows is None:
        return added(df, order.window())
    order = with_reach(order, back, ahead)
    return drop_copies(added(spread_blocks(df, order, back, ahead), block_window(order)))


def holdout_split(df: DataFrame, frac: float = 0.2, pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Add ``split``: the first ``int(n * (1 - frac))`` positions are ``train``."""
    n = df.count() if rows is None else rows
    return df.withColumn("split", F.when(F.col(pos) < holdout_start(n, frac), "train").otherwise("test"))


def holdout_start(n: int, frac: float = 0.2) -> int:
    return int(n * (1 - frac))


def fold_starts(n: int, k: int) -> tuple[list[int], int]:
    """First validation position of each of ``k`` expanding folds, and the size
    of every validation range."""
    size = n // (k + 1)
    if k < 2 or size == 0:
        raise ValueError(f"cannot cut {n} rows in {k} expanding folds")
    return [n - (k - i) * size for i in range(k)], size


def fold_of(pos: Column, n: int, k: int) -> Column:
    """Number 1..k of the fold that validates a position, 0 before the first."""
    starts, size = fold_starts(n, k)
    at = F.floor((pos - F.lit(starts[0]).cast("long")) / F.lit(size)) + 1
    return F.when(pos < starts[0], F.lit(0)).otherwise(at).cast("int")


def expanding_folds(df: DataFrame, k: int = 5, pos: str = "pos", rows: int | None = None) -> DataFrame:
    """One row per table row and fold that uses it, with ``fold`` 1..k and
    ``role``: ``validation`` for the fold's own range, ``train`` for all earlier
    positions. The folds of a row follow from its position, no join is needed."""
    n = df.count() if rows is None else rows
    own = fold_of(F.col(pos), n, k)
    return (
        df.withColumn("__own", own)
        .withColumn("fold", F.explode(F.sequence(F.greatest(F.col("__own"), F.lit(1)), F.lit(k))))
        .withColumn("role", F.when(F.col("fold") == F.col("__own"), "validation").otherwise("train"))
        .drop("__own")
    )


def head_by_time(df: DataFrame, n: int, by: str = "pos") -> DataFrame:
    """The first ``n`` rows in time order (a top-k, not a sort of the table)."""
    return df.orderBy(by).limit(n)
