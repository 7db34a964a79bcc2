"""Passages that occur more than once, by matching statistics against suffix
automata of reference shards.

Streaming every document past an automaton of the whole corpus would cost the
corpus times its number of shards. So the reference holds only what may match:

1. Anchors. Among the ``GRAM``-word hashes of a window the smallest is its anchor;
   equal windows have equal anchors. Anchors are counted, and those that occur
   more than once set a bit in a table of ``BITS`` bits, the one thing every task
   gets whole. A bit set by chance costs work, never a result.
2. Regions. Runs of windows with such anchors are cut out, and equal regions become
   one with a count. Windows inside are counted by hash; one place is kept for
   each window that occurs twice or more.
3. Shards. These reference windows are dealt to shards by their anchor, in pieces
   that share one; so are all windows of the regions. Each shard builds the suffix
   automaton of its pieces and streams the others through it: where the longest
   match that ends at a word has the window's length, the window is covered. An
   anchor with more than its part of all anchors is split over several shards, to
   each of which its reference pieces are copied.

A shard's automaton goes to the tasks that need it by a shuffle and not by a
broadcast, as all of them together grow with the corpus.

Defined results: a null text has no words, texts of fewer words than a window
lose nothing, each of several equal rows loses every word that a window covers,
an empty table gives an empty one, other columns are ignored. Windows are counted
by 64-bit hashes and matched word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import scan
from chronolode.llm.common import materialise, packed, table, unpacked

WINDOW, GRAM = 35, 8
#: Bits of the anchor table (32 MB), and of the blocks it is put together from.
BITS, BLOCK = 1 << 28, 1 << 18
#: Reference words of a shard, and the largest share of all anchors one shard takes.
SHARD_WORDS, HOT_SHARE = 30_000, 2000


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Best of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(words: scan.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window, the first words of the windows, and which gram
    positions are anchors, with their hashes."""
    hashes = words.hashes()
    n = len(hashes) - gram + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(hashes) < window:
        return none[0], none[1], none[2], hashes
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    own, at = words.runs(hashes, gram)
    grams[at] = own
    width = window - gram + 1
    least = _sliding(grams, width, np.minimum)
    whole = words.text[: len(least)] == words.text[window - 1 :]
    least = np.where(whole, least, np.uint64(0))
    wide = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = (_sliding(wide, width, np.maximum) == grams) & (grams != np.iinfo(np.uint64).max)
    starts = np.flatnonzero(whole)
    return least[starts], starts, grams[chosen], hashes


def _counted(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in scan.parts(batch.column("t")):
                chosen = anchors(scan.split(data, offsets), window, gram)[2]
                values, count = np.unique(chosen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count.astype(np.int64))], ["anchor", "n"])

    return run


def _bit(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 64 - int(math.log2(BITS)))


def _bits(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK, np.uint8)
    bits[rows["bit"].to_numpy() % BLOCK] = 1
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _regions(shared, window: int, gram: int):
    """Runs of windows whose anchors have their bit set: (key, start, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - int(math.log2(BITS)))
        for batch in batches:
            keys = batch.column("key")
            for a, _, data, offsets in scan.parts(batch.column("t")):
                words = scan.split(data, offsets)
                anchor, start, _, _ = anchors(words, window, gram)
                at = anchor >> shift
                set_ = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
                mask = np.zeros(len(words.start) + 1, bool)
                mask[start[set_ == 1]] = True
                # windows of neighbouring texts are never neighbours: the last ones of a text are no starts
                begin, end = _runs(mask)
                doc = words.text[begin] if len(begin) else begin
                texts = [
                    b" ".join(data[words.start[b] : words.end[e + window - 2]].tobytes().split()).decode()
                    for b, e in zip(begin, end, strict=True)
                ]
                columns = [keys.take(pa.array(a + doc)), pa.array((begin - words.first[doc]).astype(np.int32) if len(begin) else [], pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "text"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count = batch.column("uid").to_numpy(), batch.column("c").to_numpy()
            for a, _, data, offsets in scan.parts(batch.column("text")):
                words = scan.split(data, offsets)
                own, at = words.runs(words.hashes(), window)
                doc = words.text[at]
                columns = [own.view(np.int64), ids[a + doc], (at - words.first[doc]).astype(np.int32), count[a + doc]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "uid", "at", "c"])

    return run


def _anchor_runs(anchor: np.ndarray, start: np.ndarray, which: np.ndarray) -> list[tuple[int, int]]:
    """First and last window of each run of neighbours with one anchor."""
    at = np.flatnonzero(which)
    if not len(at):
        return []
    new = (anchor[at[1:]] != anchor[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)
    edge = np.flatnonzero(new)
    return list(zip(at[np.concatenate([[0], edge + 1])].tolist(), at[np.concatenate([edge, [len(at) - 1]])].tolist(), strict=True))


def _pieces(hot: dict[int, int], shards: int, window: int, gram: int):
    """Runs of windows with one anchor, as texts, each with its shard: those to stream
    and, at ``places``, those of the reference; one row where both are the same. A
    hot anchor has shards of its own; reference pieces go to all of them, others to
    the one their region falls to."""
    kinds = {"shard": pa.int64(), "reference": pa.bool_(), "asked": pa.bool_(), "uid": pa.int64(), "at": pa.int32(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("uid").to_numpy(), batch.column("places")
            for a, _, data, offsets in scan.parts(batch.column("text")):
                words = scan.split(data, offsets)
                anchor, start, _, _ = anchors(words, window, gram)
                wanted = np.zeros(len(words.start), bool)
                for i in range(len(offsets) - 1):
                    if places[a + i].is_valid:
                        wanted[words.first[i] + np.array(places[a + i].as_py(), np.int64)] = True
                wanted = wanted[start]
                asked = _anchor_runs(anchor, start, np.ones(len(start), bool))
                held = set(_anchor_runs(anchor, start, wanted))
                rows = [(first, last, (first, last) in held, True) for first, last in asked]
                rows += [(first, last, True, False) for first, last in sorted(held.difference(asked))]
                raw, out = data.tobytes(), []
                for first, last, reference, ask in rows:
                    b, name = int(start[first]), int(anchor[first])
                    text, doc = raw[words.start[b] : words.end[start[last] + window - 1]].decode(), int(words.text[b])
                    uid, salts = int(ids[a + doc]), hot.get(name, 1)
                    own = uid * 0x9E3779B1 % (1 << 32) % salts
                    for salt in range(salts) if reference else (own,):
                        shard = name % shards if salts == 1 else -1 - (name + salt) % (1 << 62)
                        out.append((shard, reference, ask and salt == own, uid, b - int(words.first[doc]), text))
                columns = zip(*out, strict=True) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return run


class Automaton:
    """Suffix automaton of several word lists."""

    def __init__(self) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[str]) -> None:
        to, link, length = self.to, self.link, self.length
        last = 0
        for w in words:
            known = to[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            new = len(to)
            p = last
            if known is None:
                to.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and w not in to[p]:
                    to[p][w] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
            q = to[p][w]
            if length[q] == length[p] + 1:
                link[last] = q
                continue
            copy = len(to)
            to.append(to[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            if known is None:
                link[last] = copy
            else:
                last = copy
            while p >= 0 and to[p].get(w) == q:
                to[p][w] = copy
                p = link[p]

    def covered(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """Spans of words that lie in a match of at least ``least`` words: at each word
        the longest suffix that occurs in the automaton."""
        to, link, length = self.to, self.link, self.length
        state = size = 0
        spans: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while state and w not in to[state]:
                state = link[state]
                size = length[state]
            nxt = to[state].get(w)
            if nxt is None:
                size = 0
                continue
            state, size = nxt, size + 1
            if size >= least:
                begin = i + 1 - size
                if spans and begin <= spans[-1][1]:
                    begin = min(spans.pop()[0], begin)
                spans.append((begin, i + 1))
        return spans


def _matched(window: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        automaton, known = Automaton(), {}
        texts = rows["text"].to_pylist()
        for text in {t for t, r in zip(texts, rows["reference"].to_pylist(), strict=True) if r}:
            automaton.add(text.split(" "))
        uids, begins, ends = [], [], []
        for text, ask, uid, at in zip(texts, rows["asked"].to_pylist(), rows["uid"].to_pylist(), rows["at"].to_pylist(), strict=True):
            if not ask:
                continue
            if text not in known:
                known[text] = automaton.covered(text.split(" "), window)
            for a, b in known[text]:
                uids.append(uid)
                begins.append(at + a)
                ends.append(at + b)
        return pa.table({"uid": pa.array(uids, pa.int64()), "b": pa.array(begins, pa.int32()), "e": pa.array(ends, pa.int32())})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words outside the spans, joined by one space."""
    for batch in batches:
        number, removed, kept = [], [], []
        for text, spans in zip(batch.column("t"), batch.column("spans"), strict=True):
            words = text.as_py().encode().split()
            out, at = [], 0
            if spans.is_valid:
                for b, e in sorted((s["b"], s["e"]) for s in spans.as_py()):
                    if e > at:
                        out += words[at : max(at, b)]
                        at = e
            out += words[at:]
            number.append(len(words))
            removed.append(len(words) - len(out))
            kept.append(b" ".join(out).decode())
        names = [n for n in batch.schema.names if n not in ("t", "spans")]
        columns = [pa.array(number, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_words", "n_removed", "kept_text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        digest = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column("kept_text")]
        yield batch.drop_columns(["kept_text"]).append_column("kept_sha256", pa.array(digest, pa.string()))


def _key(id_: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("\x00"), text)))


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, spans) of the rows (key, t) that have words to remove; spans of word
    numbers, which may overlap."""
    spark = keyed.sparkSession
    bare = keyed.select("key", "t")
    counted = bare.select("t").mapInArrow(_counted(window, gram), "anchor long, n long")
    counted = counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    counted = materialise(counted, "anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // HOT_SHARE)
    # at most HOT_SHARE rows, as each has more than that part of the total
    hot = {r[0] % (1 << 64): -(-r[1] // limit) for r in counted.filter(F.col("n") > limit).collect()}
    bits = counted.select(_bit(F.col("anchor")).alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / BLOCK))
    parts = bits.groupBy("block").applyInArrow(_bits, "block long, bits binary").collect()
    whole = bytearray(BITS // 8)
    for r in parts:
        whole[r[0] * BLOCK // 8 : (r[0] + 1) * BLOCK // 8] = r[1]
    shared = spark.sparkContext.broadcast(bytes(whole))

    regions = bare.mapInArrow(_regions(shared, window, gram), "key binary, start int, text string")
    regions = materialise(regions.withColumn("mark", F.unhex(F.md5("text"))), "regions")
    texts = regions.groupBy("mark").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("c"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("uid"), "mark", "c", "text"), "region-texts")
    counts = texts.select("uid", "c", "text").mapInArrow(_windows(window), "h long, uid long, at int, c long")
    # any place will do: equal hashes are equal windows
    reps = counts.groupBy("h").agg(F.sum("c").alias("n"), F.first("uid").alias("uid"), F.first("at").alias("at"))
    reps = materialise(reps.filter("n > 1").select("uid", "at"), "windows")
    shards = max(1, 3 * reps.count() // SHARD_WORDS)
    places = reps.groupBy("uid").agg(F.collect_list("at").alias("places"))
    form = "shard long, reference boolean, asked boolean, uid long, at int, text string"
    pieces = texts.join(places, "uid", "left").select("uid", "text", "places").mapInArrow(_pieces(hot, shards, window, gram), form)
    spans = pieces.groupBy("shard").applyInArrow(_matched(window), "uid long, b int, e int")
    spans = spans.groupBy("uid").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    by_mark = texts.select("uid", "mark").join(spans, "uid").select("mark", "spans")
    placed = regions.select("key", "start", "mark").join(by_mark, "mark")
    moved = F.transform("spans", lambda s: F.struct((s["b"] + F.col("start")).alias("b"), (s["e"] + F.col("start")).alias("e")))
    return placed.select("key", moved.alias("spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _joined(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = packed(docs, id=docs[id_col], t=text, key=_key(docs[id_col], text))
    spans = materialise(repeated_spans(keyed, window), "spans")
    return keyed.join(spans, "key", "left")


def passage_removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: its id, words, words removed, and a digest of the
    words that stay."""
    rows = _joined(docs, id_col, text_col, window).select(F.col("id").alias("doc_id"), "t", "spans")
    return rows.mapInArrow(_hashed, f"doc_id {rows.dtypes[0][1]}, n_words long, n_removed long, kept_sha256 string")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay in place of each text."""
    rows = _joined(docs, id_col, text_col, window).select("row", "t", "spans")
    out = rows.mapInArrow(_kept, f"row {rows.dtypes[0][1]}, n_words long, n_removed long, kept_text string")
    return unpacked(out.select(F.col("row").withField(text_col, F.col("kept_text")).alias("row")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return passage_removal(table(spark, folder, "documents"))
