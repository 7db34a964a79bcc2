"""Pairs of similar sets within lists, compared in tiles of bounded size.

A list (members that share a value) may be of any length. Its members are banded by
size, such that two sets of the asked similarity are in one band or in neighbouring
ones, and a long band is dealt into blocks by a hash. A tile is two blocks, of one
band or of neighbouring ones; it holds a bounded number of members however long
the list is, so a list that a third of all sets share is many tiles in many tasks.

Each set has a bitmap of about twice as many cells as values (at most ``MOST_CELLS``),
whose cells say whether an odd number of values fell there. The cells in which two
bitmaps differ are at most the values in which the sets do, so with their sizes they
bound the overlap from above. Tiles may carry it folded, to keep a member of a list
small however large its set; the bound holds for folded bitmaps too.
Inside a tile all pairs are compared as arrays: roots, sizes, what the list's value
leaves room for, bit counts. Only pairs that all of these let through become rows, to
be held against the whole bitmaps (``Bitmaps``) and then the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a block, and cells of a bitmap.
BLOCK, SMALL_CELLS, MOST_CELLS = 512, 512, 1 << 14
#: Words of 64 cells compared at once.
_AT_ONCE = 1 << 20


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity of the values in each cell, 64 cells a number."""
    cells = min(MOST_CELLS, max(SMALL_CELLS, 1 << (2 * len(values) - 1).bit_length()))
    odd = np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: Column, least: int = SMALL_CELLS // 64, to: Column | int = 0) -> Column:
    """A bitmap of any width as one of few words: ``to``, or ``least`` if that is more."""
    words = F.greatest(F.lit(to).cast("int"), F.lit(least))
    part = F.transform(F.sequence(F.lit(0), (F.size(bits) / words).cast("int") - 1), lambda i: F.slice(bits, i * words + 1, words))
    zero = F.array_repeat(F.lit(0).cast("long"), words)
    return F.aggregate(part, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def band_edges(percent: int, largest: int) -> list[int]:
    """The smallest size of each band: sets of sizes a <= b with 100 a >= percent b
    lie in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(100 * edges[-1] // percent + 1)
    return edges


class Bitmaps:
    """The bitmaps of a batch, by number of words."""

    def __init__(self, column: pa.ListArray) -> None:
        self.width = column.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(self.width)
        flat = column.flatten().to_numpy()
        self.row = np.zeros(len(self.width), np.int64)
        self.by_width = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.row[rows] = np.arange(len(rows))
            self.by_width[w] = flat[(ends[rows] - w)[:, None] + np.arange(w)]

    def _words(self, i: np.ndarray, width: int, to: int) -> np.ndarray:
        """The bitmaps of rows ``i``, folded to as few words."""
        out = self.by_width[width][self.row[i]]
        while width > to:
            width //= 2
            out = out[:, :width] ^ out[:, width:]
        return out

    def differ(self, i: np.ndarray, other: Bitmaps, j: np.ndarray) -> np.ndarray:
        """In how many cells bitmaps i and j differ, pair by pair."""
        out = np.zeros(len(i), np.int64)
        wide = self.width[i] * (1 << 32) + other.width[j]
        for both in np.unique(wide).tolist():
            wi, wj = both >> 32, both & ((1 << 32) - 1)
            to, at = min(wi, wj), np.flatnonzero(wide == both)
            step = max(1, _AT_ONCE // max(wi, wj))
            for k in range(0, len(at), step):
                p = at[k : k + step]
                x = self._words(i[p], wi, to) ^ other._words(j[p], wj, to)
                out[p] = np.bitwise_count(x.view(np.uint64)).sum(1)
        return out


def possible(na: np.ndarray, nb: np.ndarray, differ: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many values, at least, can have
    the similarity."""
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _pairs(tile: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare; rows of a tile stand together. Side 2: with every
    other row of the tile; sides 0 and 1: with each other."""
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    ends = np.append(starts[1:], len(tile))
    held, n = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        own = np.arange(a, b)
        sides = [own[side[a:b] == s] for s in (0, 1, 2)]
        if len(sides[2]) > 1:
            i, j = np.triu_indices(len(sides[2]), 1)
            held.append((sides[2][i], sides[2][j]))
            n += len(i)
        if len(sides[0]) and len(sides[1]):
            held.append((np.repeat(sides[0], len(sides[1])), np.tile(sides[1], len(sides[0]))))
            n += len(held[-1][0])
        if n > _AT_ONCE // 4:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _met_before(i: np.ndarray, j: np.ndarray, before: pa.ListArray) -> np.ndarray:
    """Whether rows i and j of a pair share a value that comes before their list's."""
    lengths = before.value_lengths().to_numpy().astype(np.int64)
    values, number = np.unique(before.flatten().to_numpy(), return_inverse=True)
    starts = np.cumsum(lengths) - lengths

    def keys(rows: np.ndarray) -> np.ndarray:
        n = lengths[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[rows], n)
        return pair * len(values) + number[place]

    shared = keys(i)
    shared = shared[np.isin(shared, keys(j))]
    out = np.zeros(len(i), bool)
    out[shared // max(1, len(values))] = True
    return out


def _compared(percent: int):
    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, root, size, room = (batch.column(c).to_numpy() for c in ("node", "root", "n", "room"))
        bits = Bitmaps(batch.column("bits"))
        found = [np.zeros((0, 2), np.int64)]
        for i, j in _pairs(batch.column("tile").to_numpy(), batch.column("side").to_numpy()):
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            some = (root[i] != root[j]) & (100 * small >= percent * large)
            some &= (100 + percent) * np.minimum(room[i], room[j]) >= percent * (small + large)
            i, j = i[some], j[some]
            good = possible(size[i], size[j], bits.differ(i, bits, j), percent)
            i, j = i[good], j[good]
            if "before" in batch.schema.names and len(i):
                first = ~_met_before(i, j, batch.column("before"))
                i, j = i[first], j[first]
            a, b = node[i], node[j]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        # a batch holds many lists of the same members
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            other = np.flatnonzero(tile != tile[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and last != tile[-1]):  # all but the last tile is complete
                yield close(pa.concat_batches([*held, batch[:cut]]))
                held = []
            held.append(batch[cut:])
            last = tile[-1]
        if held:
            yield close(pa.concat_batches(held))

    return run


def similar_pairs(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of members of one list with different roots that may be
    similar. members: (h, node, root, n, room, bits), where bits are folded, and room is
    the most values that a member can share with one it meets in no list before (n
    where nothing is known); percent: 50 to 99. A further column ``before`` names the
    lists of a member that come before h in an order common to all; then a pair is told
    in the first of its lists only."""
    more = [c for c in ("before",) if c in members.columns]
    edges = F.array(*[F.lit(e) for e in band_edges(percent, 1 << 40)])
    banded = members.withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("n"))))
    counts = banded.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"))
    blocks = counts.select("h", "band", F.ceil(F.col("c") / block).cast("int").alias("blocks"), "c")
    lists = blocks.groupBy("h").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    long_lists = lists.filter(F.col("all") > block).select("h", "blocks")
    at = banded.join(long_lists, "h", "left")
    own = F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("band"))).cast("int")

    def others(step: int) -> Column:
        n = F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def tile(low: Column, x: Column, high: Column, y: Column) -> Column:
        return F.xxhash64("h", low, x, high, y)

    same = F.transform(
        others(0),
        lambda k: F.struct(
            tile(F.col("band"), F.least("own", k), F.col("band"), F.greatest("own", k)).alias("tile"),
            F.when(k == F.col("own"), 2).otherwise((F.col("own") > k).cast("int")).alias("side"),
        ),
    )
    up = F.transform(others(1), lambda k: F.struct(tile(F.col("band"), F.col("own"), F.col("band") + 1, k).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(others(-1), lambda k: F.struct(tile(F.col("band") - 1, k, F.col("band"), F.col("own")).alias("tile"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.xxhash64("h").alias("tile"), F.lit(2).alias("side")))
    tiles = F.when(F.col("blocks").isNull(), whole).otherwise(F.concat(same, up, down))
    dealt = at.withColumn("own", own).select("node", "root", "n", "room", "bits", *more, F.explode(tiles).alias("t"))
    dealt = dealt.select("t.tile", "t.side", "node", "root", "n", "room", "bits", *more)
    in_tiles = dealt.repartition("tile").sortWithinPartitions("tile")
    return in_tiles.mapInArrow(_compared(percent), "a long, b long").distinct()
