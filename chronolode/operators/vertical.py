"""Frequent itemsets by bitmaps of baskets.

Distinct baskets are numbered and cut into blocks. A block holds, for each of its
items, a bitmap of the baskets that have the item, and the weights of its baskets as
bitmaps of their binary digits. The transactions of a set in a block are then the AND
of its items' bitmaps, each digit's bits counted and shifted to its place.

Blocks are written once and each level reads them once per group of candidates. What a
level shuffles is one count per candidate and task, so it does not depend on how many
baskets hold how many sets, unlike in mining that carries the sets of each basket along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.operators.itemsets import _frequent, _level_one, _pruned, candidate_sets, distinct_baskets
from chronolode.sources.scratch import materialise

#: Baskets of a block, bytes of its bitmaps, and candidates sent to the tasks at a time.
BLOCK, BLOCK_BYTES = 1 << 15, 64 << 20
CANDIDATES = 200_000
#: Bytes of ANDed bitmaps that a task holds at a time.
_ROOM = 32 << 20


def _block_size(items: int) -> int:
    """Baskets of a block, a power of two: fewer if there are many items."""
    size = BLOCK
    while size > 64 and size // 8 * items > BLOCK_BYTES:
        size //= 2
    return size


def basket_blocks(baskets: DataFrame, size: int) -> DataFrame:
    """(block, digit, item, bits) of distinct baskets (id, items, w): the baskets that have
    the item, or, without item, whose weight has this binary digit."""
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda d: F.getbit(F.col("w"), d) == 1)
    items = baskets.select("id", F.explode("items").alias("item"), F.lit(None).cast("int").alias("digit"))
    weights = baskets.select("id", F.lit(None).cast("string").alias("item"), F.explode(digits).alias("digit"))
    cells = items.unionByName(weights)
    block = F.shiftright("id", size.bit_length() - 1)
    # the aggregate always makes a bitmap of 4096 bytes, the rest of a smaller block's is empty
    bits = F.substring(F.bitmap_construct_agg(F.col("id").bitwiseAND(F.lit(size - 1))), 1, size // 8)
    return cells.groupBy(block.alias("block"), "item", "digit").agg(bits.alias("bits"))


def _stacked(blocks: DataFrame) -> DataFrame:
    """One row per block: its items' bitmaps and those of its digits."""
    held = F.struct("item", "bits")
    weight = F.struct("digit", "bits")
    return blocks.groupBy("block").agg(
        F.collect_list(F.when(F.col("digit").isNull(), held)).alias("items"),
        F.collect_list(F.when(F.col("digit").isNotNull(), weight)).alias("digits"),
    )


def _bitmaps(entries: pa.StructArray, width: int) -> np.ndarray:
    whole = b"".join(entries.field("bits").to_pylist())
    return np.frombuffer(whole, np.uint64).reshape(-1, width)


def _counting(shared, size: int):
    """Transactions of every candidate, added up over the blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, sets = shared.value
        of = {name: i for i, name in enumerate(names)}
        total, width = np.zeros(len(keys), np.int64), size // 64
        step = max(1, _ROOM // (width * 8))
        for batch in batches:
            for i in range(batch.num_rows):
                items, digits = batch.column("items")[i].values, batch.column("digits")[i].values
                # items of no candidate here share a last, empty row
                maps = np.vstack([_bitmaps(items, width), np.zeros((1, width), np.uint64)])
                row = np.full(len(names), len(maps) - 1)
                for j, name in enumerate(items.field("item").to_pylist()):
                    if name in of:
                        row[of[name]] = j
                places = row[sets]
                here = np.flatnonzero((places < len(maps) - 1).all(axis=1))
                planes = list(zip(digits.field("digit").to_pylist(), _bitmaps(digits, width), strict=True))
                for a in range(0, len(here), step):
                    part = here[a : a + step]
                    both = maps[places[part, 0]]
                    for column in range(1, sets.shape[1]):
                        both &= maps[places[part, column]]
                    for digit, plane in planes:
                        total[part] += np.bitwise_count(both & plane).sum(axis=1, dtype=np.int64) << digit
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[held]), pa.array(total[held])], ["key", "n"])

    return run


def _counts(blocks: DataFrame, size: int, candidates: DataFrame, at_once: int) -> DataFrame:
    """(itemset, n_tx) of candidates of one common size, at most ``at_once`` in a pass."""
    spark = blocks.sparkSession
    count = candidates.count()
    passes = max(1, -(-2 * count // at_once)) if count > at_once else 1
    numbered = candidates.select(F.monotonically_increasing_id().alias("key"), "itemset")
    numbered = materialise(numbered.withColumn("part", F.pmod(F.xxhash64("itemset"), F.lit(passes)).cast("int")), "candidates")
    counts = None
    for part in range(passes):
        # one part of a hash, about half of ``at_once`` rows
        chosen = numbered.where(F.col("part") == part).select("key", "itemset").toArrow().combine_chunks()
        if not chosen.num_rows:
            continue
        names, sets = np.unique(np.array(chosen["itemset"].combine_chunks().flatten().to_pylist(), object), return_inverse=True)
        shared = spark.sparkContext.broadcast((chosen["key"].to_numpy(), names.tolist(), sets.reshape(chosen.num_rows, -1)))
        rows = blocks.select("items", "digits").mapInArrow(_counting(shared, size), "key long, n long")
        counted = materialise(rows.groupBy("key").agg(F.sum("n").alias("n_tx")), "counts")
        shared.destroy()
        counts = counted if counts is None else counts.unionByName(counted)
    if counts is None:
        return candidates.select("itemset", F.lit(0).cast("long").alias("n_tx"))
    return numbered.join(counts, "key").select("itemset", "n_tx")


def itemsets_by_bitmaps(
    tx: DataFrame,
    min_support: float = 0.05,
    max_len: int = 3,
    items: str = "items",
    weight: str | None = None,
    at_once: int = CANDIDATES,
    block: int | None = None,
) -> DataFrame:
    """All itemsets of up to ``max_len`` items held by at least ``min_support`` of the
    transactions, as ``(itemset, n_tx, support)``, like ``frequent_itemsets``.

    Pairs are counted by joining the cells of equal baskets; longer sets by bitmaps,
    ``at_once`` candidates in a pass over the blocks. ``block`` (a power of two from 64
    to ``BLOCK``) is the number of baskets in a block, by default so many that a block's
    bitmaps take ``BLOCK_BYTES`` at most, as far as blocks of 64 baskets allow.
    """
    whole = materialise(distinct_baskets(tx, items, weight), "baskets")
    n = whole.agg(F.sum("w")).first()[0] or 1
    found = level = materialise(_level_one(whole, n, min_support), "itemsets")
    baskets = _pruned(whole, level.select(F.col("itemset")[0].alias("item")))
    if max_len >= 2:
        level = materialise(_pairs(baskets, n, min_support), "itemsets")
        found = found.unionByName(level)
    if max_len < 3 or level.isEmpty():
        return found
    size = block or _block_size(found.where(F.size("itemset") == 1).count())
    blocks = materialise(_stacked(basket_blocks(baskets, size)), "blocks")
    for _ in range(3, max_len + 1):
        counts = _counts(blocks, size, materialise(candidate_sets(level), "candidates"), at_once)
        level = materialise(_frequent(counts, n, min_support), "itemsets")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def _pairs(baskets: DataFrame, n: int, min_support: float) -> DataFrame:
    cells = baskets.select("id", "w", F.explode("items").alias("a"))
    more = cells.select("id", F.col("a").alias("b"))
    counts = cells.join(more, "id").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum("w").alias("n_tx"))
    return _frequent(counts.select(F.array("a", "b").alias("itemset"), "n_tx"), n, min_support)
