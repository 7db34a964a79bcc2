"""Near duplicates: bottom-k sketches of one hash function, inverted lists of the
retained values, a union-sketch estimate, and exact Jaccard on full sets.

1. Documents with equal shingle sets are one node, so copies are never paired.
2. A sketch keeps the ``k`` smallest hashes of a set. Two sets of similarity
   ``t`` share at least ``m`` of their retained values, where fewer has a chance of
   ``MISS`` at most (a binomial tail; sets no larger than ``k`` are kept whole). So
   with all values in one global order, two such sketches also share one among
   the first ``k - m + 1``, and only these enter the inverted lists. The order is
   rarest first, by a table of ``COUNTERS`` counters; any order is correct, this one
   leaves passages that many documents share out of the lists.
3. Links are found in rounds. In the first ones each list pairs its members with
   one of them only, at first the one with the fewest rarer values; members of a
   large group of near copies so meet in one component without all their pairs.
   The last round compares what is still apart in a list, every two members in
   different components, in tiles of bounded size (``tiles``).
4. Each set also has a bitmap, whose cells say whether an odd number of values fell
   there. The cells in which two sets differ are at most the values in which they
   do, so a pair with too many cannot be similar; tiles test this before they make
   a row, and make it in the first list that the two share. What passes goes on if
   the estimate from the union of both sketches allows the similarity, and is then
   decided on full sets, a few pairs of arrays in a worker at a time.

Lists and pairs are joined by shuffles that Spark can split at a frequent value.

Defined results: a null or wordless text has no shingles and no links, a text of
fewer words than a shingle is one shingle, rows that repeat a text share a node,
a component without any id has null, an empty table gives an empty one, a very long
text is handled whole (its array of shingles is the largest value in a task), other
columns are ignored. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import scan
from chronolode.llm.common import materialise, packed, table, unpacked, written
from chronolode.llm.components import components
from chronolode.llm.tiles import Bitmaps, bitmap, folded, possible, similar_pairs

SHINGLE = 5
#: Similarity from which documents are linked, in percent.
PERCENT = 75
K = 64
MISS = 1e-10
COUNTERS = 1 << 18
#: Pairs with both their sets handed to a Python worker at a time.
PAIRS_AT_ONCE = 16
#: Rounds that pair lists with one member, before the one that pairs all.
STAR_ROUNDS = 2


@lru_cache(maxsize=None)
def sure_overlap(size: int, percent: int) -> int:
    """The largest m with P(Binomial(size, percent/100) < m) <= MISS, at least 1."""
    p, below, m = percent / 100, 0.0, 0
    while m < size:
        below += math.comb(size, m) * p**m * (1 - p) ** (size - m)
        if below > MISS:
            break
        m += 1
    return max(1, m)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words = scan.split(data, offsets, lower=True)
    hashes = words.hashes()
    runs, at = words.runs(hashes, length)
    bounds = np.searchsorted(at, words.first)
    count = np.diff(words.first)
    out = []
    for i, n in enumerate(count):
        if n >= length:
            out.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
        elif n:
            few = hashes[words.first[i] : words.first[i + 1]]
            out.append(scan.mix(np.array([(few * scan._STEPS[: len(few)]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketched(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in scan.parts(batch.column("t")):
                sets = shingle_sets(data, offsets, length)
                sizes = np.array([len(s) for s in sets], np.int64)
                kept = [s[:k] for s in sets]
                bits = [bitmap(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                mark = [s.sum().tobytes() + scan.mix(s + np.uint64(n)).sum().tobytes() for s, n in zip(sets, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(a, b - a) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "t"),
                        pa.array(sizes),
                        pa.array(mark, pa.binary()),
                        scan.lists(np.concatenate(kept).view(np.int64), np.minimum(sizes, k)),
                        scan.lists(np.concatenate(bits), np.array([len(x) for x in bits])),
                    ],
                    [*(n for n in batch.schema.names if n != "t"), "n", "mark", "sketch", "bits"],
                )

    return run


def _ordered(counts: bytes, percent: int):
    """The leading values of each sketch in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(counts, np.uint32)
        for batch in batches:
            nodes, column = batch.column("node").to_numpy(), batch.column("sketch")
            values, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
            picked = [np.zeros(0, np.uint64)]
            for i, end in enumerate(ends):
                own = values[(ends[i - 1] if i else 0) : end]
                rare = np.lexsort((own, often[own % np.uint64(len(often))]))
                picked.append(own[rare[: len(own) - sure_overlap(len(own), percent) + 1]])
            lengths = [len(p) for p in picked[1:]]
            rarer = np.concatenate([np.arange(n, dtype=np.int32) for n in [0, *lengths]])
            columns = [pa.array(np.concatenate(picked).view(np.int64)), pa.array(np.repeat(nodes, lengths)), pa.array(rarer)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "node", "rarer"])

    return run


def _likely(k: int, percent: int):
    """Pairs whose sizes and bitmaps allow the similarity and whose union sketch shares
    as many values as it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            na, nb = (batch.column(f"n_{side}").to_numpy() for side in "ab")
            ba, bb = (Bitmaps(batch.column(f"bits_{side}")) for side in "ab")
            good = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            good[good] = possible(na[good], nb[good], ba.differ(rows[good], bb, rows[good]), percent)
            sides = []
            for c in ("sketch_a", "sketch_b"):
                column = batch.column(c)
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
                sides.append((column.flatten().to_numpy().view(np.uint64), ends))
            (va, ea), (vb, eb) = sides
            for i in np.flatnonzero(good):
                both = np.sort(np.concatenate([va[ea[i] : ea[i + 1]], vb[eb[i] : eb[i + 1]]]))
                new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                size = min(k, len(new))
                smallest = new[k] if len(new) > k else len(both)
                good[i] = smallest - size >= sure_overlap(size, percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _whole_sets(length: int):
    """The full set of each node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in scan.parts(batch.column("t")):
                sets = shingle_sets(data, offsets, length)
                values = scan.lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), values], ["node", "set"])

    return run


def _verified(percent: int):
    """Pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (batch.column(f"set_{side}")[i].values.to_numpy().view(np.uint64) for side in "ab")
                place = np.searchsorted(x, y)
                place[place == len(x)] = 0
                shared = int(np.count_nonzero(x[place] == y))
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _order_counts(nodes: DataFrame) -> bytes:
    """How many sketches keep a value, by cells of a table of fixed size."""
    cells = nodes.select(F.explode("sketch").alias("h")).groupBy((F.col("h").bitwiseAND(COUNTERS - 1)).alias("cell"))
    out = np.zeros(COUNTERS, np.uint32)
    told = cells.agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()
    out[told["cell"].to_numpy()] = told["n"].to_numpy()
    return out.tobytes()


def _text_key(id_: Column, text: Column) -> Column:
    """128 bits by which a row is found again."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("\x00"), text)))


class _Search:
    """Candidate pairs of one corpus, and their links."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, length: int, percent: int, k: int) -> None:
        self.texts, self.nodes, self.length, self.percent, self.k = texts, nodes, length, percent, k
        lists = nodes.select("node", "sketch").mapInArrow(_ordered(_order_counts(nodes), percent), "h long, node long, rarer int")
        several = lists.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
        self.lists = materialise(lists.join(several, "h"), "lists")

    def star(self, lists: DataFrame, turn: int) -> DataFrame:
        """Each list's members with one of them, another one each turn."""
        rank = F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.col("rarer"), "node")
        one = lists.groupBy("h").agg(F.min_by(F.struct("node", "root"), rank).alias("one"))
        met = lists.join(one, "h").filter("node <> one.node AND root <> one.root").select("node", F.col("one.node").alias("other"))
        return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def every(self, lists: DataFrame) -> DataFrame:
        """Every two members of a list that are in different components and may be
        similar."""
        half = folded(F.col("bits"), to=F.size("bits") / 2)  # as many cells as values, or up to twice as many
        small = self.nodes.select("node", "n", F.col("n").alias("room"), half.alias("bits"))
        own = self.lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rarer", "h"))).alias("own"))
        before = F.transform(F.filter("own", lambda x: x["rarer"] < F.col("rarer")), lambda x: x["h"])
        members = lists.join(small.join(own, "node"), "node").withColumn("before", before).drop("own", "rarer")
        return similar_pairs(members, self.percent)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""
        likely = self._with_both(pairs, self.nodes, "n", "bits", "sketch").mapInArrow(_likely(self.k, self.percent), "a long, b long")
        likely = materialise(likely, "pairs")
        asked = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        keys, _ = written(self.nodes.select("node", "key").join(asked, "node"), "asked")
        found = self.texts.join(keys, "key").select("node", "t").mapInArrow(_whole_sets(self.length), "node long, set array<long>")
        # rows that agree in id and text share a key
        sets = materialise(found.dropDuplicates(["node"]), "sets", 256)
        return materialise(self._with_both(likely, sets, "set").mapInArrow(_verified(self.percent), "a long, b long"), "links", PAIRS_AT_ONCE)

    def _with_both(self, pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    def roots(self) -> DataFrame:
        """(node, root) of all nodes with links."""
        links = roots = None
        tried: DataFrame | None = None
        for turn in range(STAR_ROUNDS + 1):
            lists = self.lists.withColumn("root", F.col("node"))
            if roots is not None:
                lists = self.lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                apart = lists.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
                lists = materialise(lists.join(apart, "h"), "apart")
            pairs = self.star(lists, turn) if turn < STAR_ROUNDS else self.every(lists)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "candidates")
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = self.linked(pairs)
            links = new if links is None else links.unionByName(new)
            if turn and not new.head(1):
                continue
            roots = materialise(components(links), "roots")
        return roots


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return packed(docs, id=docs[id_col], t=text, key=_text_key(docs[id_col], text))


def _classes(keyed: DataFrame, length: int = SHINGLE, percent: int = PERCENT, k: int = K) -> DataFrame:
    """(id, key, n, least) per row; least: id and key of the row that stands for its
    component."""
    bare = keyed.drop("row")
    rows = materialise(
        bare.mapInArrow(_sketched(length, k), f"id {dict(bare.dtypes)['id']}, key binary, n long, mark binary, sketch array<long>, bits array<long>"),
        "sketches",
    )
    full = rows.filter("n > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key")))
    # all rows of a node have the same set, so any of their sketches will do
    nodes = full.groupBy("mark").agg(best.alias("best"), *[F.first(c).alias(c) for c in ("n", "sketch", "bits")])
    nodes = materialise(
        nodes.select("mark", "best", F.col("best.key").alias("key"), "n", "sketch", "bits", F.monotonically_increasing_id().alias("node")),
        "nodes",
    )
    roots = _Search(keyed.select("key", "t"), nodes, length, percent, k).roots()
    placed = nodes.select("node", "mark", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "placed")
    least = placed.groupBy("root").agg(F.min("best").alias("least"))
    marks = placed.join(least, "root").select("mark", "least")
    alone = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    return rows.drop("sketch", "bits").join(marks, "mark", "left").withColumn("least", F.coalesce("least", alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row per row of ``docs``: its id, the size of its shingle set, the smallest
    id of its component and whether it is that document."""
    return _classes(_keyed(docs, id_col, text_col), **settings).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("least.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least.id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """One row of each component, with all its columns."""
    keyed = _keyed(docs, id_col, text_col)
    stay = _classes(keyed, **settings).filter(F.col("key") == F.col("least.key")).select("key").distinct()
    stay, _ = written(stay, "stay")
    # rows that agree in id and text share a key; one of them is enough
    return unpacked(keyed.join(stay, "key").dropDuplicates(["key"]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
