"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by tiles of
size bands with hashed bitmap signatures, then exact intersections of sorted arrays.

1. Documents with equal sets are one node, so copies are never paired.
2. Two sets of similarity ``t`` share one of the first ``n - ceil(t n) + 1`` values of
   each in any order common to all. The order is rarest first, by a table of
   ``COUNTERS`` counters over all documents (any order is correct, this one leaves
   passages that many documents share out of the lists). Only these leading values
   make lists. A member at place ``i`` of its values has room for ``n - i`` shared ones
   with a set that it meets in no list before; pairs without enough are left to
   an earlier list.
3. In the first ``STARS`` rounds a list compares its members with one of them, so large
   groups of near copies become one component without all their pairs. The last
   round compares all members of a list that are still in different components, in
   tiles (``tiles``): two blocks of neighbouring size bands, where bit counts of
   bitmaps bound the overlap from above; pairs are then held against wider bitmaps.
4. What the bound lets through is decided on both full sets, as sorted arrays.

No link is lost: every pair of linked nodes either meets in the last round or is in
one component before. Lists are joined by shuffles that Spark can split at a frequent
value, and tiles are of bounded size.

Defined results: a null or wordless text has an empty set and no links; a text of
fewer words than an n-gram is one n-gram; rows that repeat a text share a node; a
component without any id has null, else its smallest id; an empty table gives an
empty one; a very long text is handled whole, its arrays are the largest value in a
task; other columns are ignored whatever their names. N-grams are compared as 64-bit
hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import scan
from chronolode.llm.common import materialise, table, written
from chronolode.llm.components import components
from chronolode.llm.tiles import Bitmaps, bitmap, folded, possible, similar_pairs

#: Words of an n-gram, and similarity from which documents link, in percent.
LENGTH, PERCENT = 4, 85
COUNTERS = 1 << 20
_CHUNKS = 256
STARS = 2
#: Pairs with both their arrays handed to a Python worker at a time.
PAIRS_AT_ONCE = 16


def ngram_sets(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    words = scan.split(data, offsets, lower=True)
    hashes = words.hashes()
    runs, at = words.runs(hashes, length)
    bounds = np.searchsorted(at, words.first)
    for i, n in enumerate(np.diff(words.first).tolist()):
        if 0 < n < length:  # the words in order, and how many they are
            one = np.uint64(n)
            for h in hashes[words.first[i] : words.first[i + 1]]:
                one = scan.mix(np.array([one ^ h], np.uint64))[0]
            yield np.array([one], np.uint64)
        else:
            yield np.unique(runs[bounds[i] : bounds[i + 1]])


def leading(size: int, percent: int) -> int:
    """How many values, first in a common order, hold one that similar sets share."""
    return size + percent * size // -100 + 1


def _counted(length: int):
    """How many documents of a task have a value in a cell, by ``_CHUNKS`` of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, data, offsets in scan.parts(batch.column("t")):
                values = np.concatenate([np.zeros(0, np.uint64), *ngram_sets(data, offsets, length)])
                total += np.bincount((values >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        parts = [x.tobytes() for x in np.split(total.astype(np.uint32), _CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array(parts, pa.binary())], ["chunk", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of all tasks, added up, as ranks: eighths of a power of two."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
            total[chunk] = total[chunk] + own if chunk in total else own
    ranks = [np.minimum(255, np.rint(8 * np.log2(np.maximum(t, 1)))).astype(np.uint8).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["chunk", "ranks"])


def _order(texts: DataFrame, length: int) -> np.ndarray:
    """A rank of each cell by how often its values occur, one byte a cell."""
    counts = texts.select("t").mapInArrow(_counted(length), "chunk int, counts binary")
    ranks = counts.repartition("chunk").mapInArrow(_added, "chunk int, ranks binary").collect()
    out = np.zeros((_CHUNKS, COUNTERS // _CHUNKS), np.uint8)
    for chunk, own in ranks:
        out[chunk] = np.frombuffer(own, np.uint8)
    return out.ravel()


def _signed(length: int, percent: int, order: np.ndarray):
    """Of each text: size of its set, 128 bits of it, leading values and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in scan.parts(batch.column("t")):
                sizes, marks, lead, bits = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for s in ngram_sets(data, offsets, length):
                    sizes.append(len(s))
                    marks.append(s.sum().tobytes() + scan.mix(s + np.uint64(len(s))).sum().tobytes())
                    rank = order[(s >> np.uint64(44)).astype(np.int64)]
                    lead.append(s[np.lexsort((s, rank))[: leading(len(s), percent)]] if len(s) else s)
                    bits.append(bitmap(s) if len(s) else np.zeros(0, np.int64))
                own = [(n, c.slice(a, b - a)) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "t"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c for _, c in own), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                        scan.lists(np.concatenate(lead).view(np.int64), np.array([len(x) for x in lead[1:]])),
                        scan.lists(np.concatenate(bits), np.array([len(x) for x in bits[1:]])),
                    ],
                    [*(n for n, _ in own), "n", "mark", "lead", "bits"],
                )

    return run


def _arrays(length: int):
    """The whole set of each node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in scan.parts(batch.column("t")):
                sets = list(ngram_sets(data, offsets, length))
                values = scan.lists(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), values], ["node", "values"])

    return run


def _allowed(percent: int):
    """Pairs that bit counts let be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (Bitmaps(batch.column(f"bits_{side}")) for side in "ab")
            all_rows = np.arange(batch.num_rows)
            na, nb = (batch.column(f"n_{side}").to_numpy() for side in "ab")
            good = possible(na, nb, a.differ(all_rows, b, all_rows), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _exact(percent: int):
    """Pairs whose whole sets are similar; arrays are ascending as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (batch.column(f"values_{side}")[i].values.to_numpy().view(np.uint64) for side in "ab")
                at = np.searchsorted(x, y)
                shared = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _pairs_with(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


class _Join:
    """The links of one corpus."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, length: int, percent: int) -> None:
        self.texts, self.nodes, self.length, self.percent = texts, nodes, length, percent
        lead = nodes.select("node", "n", F.posexplode("lead").alias("at", "h")).withColumn("room", F.col("n") - F.col("at")).drop("at")
        several = lead.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
        self.lists = materialise(lead.join(several, "h"), "lists")

    def star(self, lists: DataFrame, turn: int) -> DataFrame:
        """Each list's members with one of them, at first the one with the fewest rarer
        values, which an edited copy has more of, then one by a hash."""
        rank = F.struct(F.xxhash64("node", F.lit(turn)) if turn else F.col("n") - F.col("room"), "node")
        one = lists.groupBy("h").agg(F.min_by(F.struct("node", "root", "n", "room"), rank).alias("one"))
        close = 100 * F.least("n", "one.n") >= self.percent * F.greatest("n", "one.n")
        close &= (100 + self.percent) * F.least("room", "one.room") >= self.percent * (F.col("n") + F.col("one.n"))
        met = lists.join(one, "h").filter(F.expr("node <> one.node AND root <> one.root") & close)
        return met.select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()

    def every(self, lists: DataFrame) -> DataFrame:
        """All members of a list that are in different components, in tiles."""
        return similar_pairs(lists.join(self.nodes.select("node", folded(F.col("bits")).alias("bits")), "node"), self.percent)

    def allowed(self, pairs: DataFrame) -> DataFrame:
        return _pairs_with(pairs, self.nodes, "n", "bits").mapInArrow(_allowed(self.percent), "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links. The sets of their nodes are made from the texts."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        keys, _ = written(self.nodes.select("node", "key").join(asked, "node"), "asked")
        found = self.texts.join(keys, "key").select("node", "t").mapInArrow(_arrays(self.length), "node long, values array<long>")
        # rows that agree in id and text share a key
        sets = materialise(found.dropDuplicates(["node"]), "sets", 256)
        return materialise(_pairs_with(pairs, sets, "values").mapInArrow(_exact(self.percent), "a long, b long"), "links", PAIRS_AT_ONCE)

    def roots(self) -> DataFrame:
        """(node, root) of all nodes with links."""
        links = roots = tried = None
        for turn in range(STARS + 1):
            lists = self.lists.withColumn("root", F.col("node"))
            if roots is not None:
                lists = self.lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                apart = lists.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
                lists = materialise(lists.join(apart, "h"), "apart")
            pairs = self.star(lists, turn) if turn < STARS else self.every(lists)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialise(self.allowed(materialise(pairs, "pairs")), "candidates")
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = self.linked(pairs)
            links = new if links is None else links.unionByName(new)
            if roots is None or not new.isEmpty():
                roots = materialise(components(links), "roots")
        return roots


def ngram_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest
    id reachable by links; percent: 50 to 99."""
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("\x00"), text)))
    texts = docs.select(docs[id_col].alias("id"), text.alias("t"), key.alias("key"))
    id_type = dict(texts.dtypes)["id"]
    signed = texts.mapInArrow(
        _signed(length, percent, _order(texts, length)),
        f"id {id_type}, key binary, n long, mark binary, lead array<long>, bits array<long>",
    )
    rows = materialise(signed, "signatures", 256)
    alone = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    # all rows of a node have the same set, so any of their signatures will do
    nodes = rows.filter("n > 0").groupBy("mark").agg(F.min(alone).alias("best"), *[F.first(c).alias(c) for c in ("n", "lead", "bits")])
    nodes = materialise(nodes.withColumns({"key": F.col("best.key"), "node": F.monotonically_increasing_id()}), "nodes")
    roots = _Join(texts.select("key", "t"), nodes, length, percent).roots()
    placed = nodes.select("node", "mark", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "placed")
    least = placed.groupBy("root").agg(F.min("best").alias("least"))
    marks = placed.join(least, "root").select("mark", "least")
    joined = rows.select("id", "key", "n", "mark").join(marks, "mark", "left").withColumn("least", F.coalesce("least", alone))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_links(table(spark, folder, "documents"))
