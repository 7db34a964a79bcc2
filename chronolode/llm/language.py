"""Language of texts by unigram models over the pieces of a fixed vocabulary, all
segmentations summed.

A word is a run of letters, lower-cased, with a mark before it. Under a language
its probability is the sum, over every way to cut it into pieces, of the product
of piece probabilities, which the forward algorithm takes in one pass over its
letters. The log-probabilities of a text's words add up, with the share of the
language among labelled documents as prior, and the posterior of the best one is
the score.

Piece probabilities are learned by expectation maximisation: expected uses of a
piece over all segmentations of each language's words. Words are counted first,
by language, so each step reads every distinct word once, and its sums are whole
numbers (in fractions of 2^-20), which add up alike in any order. The model that
every task gets has a row per piece of the vocabulary and a column per language.

Single letters are always a piece; one that the vocabulary lacks has the
probability of one unseen use.

Defined results: ``und`` and score 0 for a null text, one without letters, and
where no labelled document is left to learn from; equal posteriors go to the
language first in order; rows without id are not held out; repeated rows count
each; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm import scan
from chronolode.llm.common import materialise, table

UNKNOWN = "und"
#: Steps of expectation maximisation, and uses given to every piece beforehand.
STEPS, PRIOR_USES = 3, 0.1
_LETTERS = re.compile(r"[^\W\d_]+")
#: Documents whose words are scored together, and words whose lattice is built together.
TOGETHER, WORDS = 1500, 1 << 16
#: Longer words are learned from in blocks.
_LONG = 60
_FRACTION = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as a hash table over code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.names = names
        self.size = len(names)
        self.longest = max(map(len, names))
        keys = np.array([self._hash(p) for p in names], np.uint64)
        # two tables: what collides in the first one is in the second
        self.bits = 19
        self.tables = []
        left = np.arange(len(names))
        for turn in range(4):
            slot = self._slot(keys[left], turn)
            key, at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            _, one = np.unique(slot, return_index=True)
            key[slot[one]], at[slot[one]] = keys[left[one]], left[one]
            self.tables.append((key, at))
            left = np.delete(left, one)
            if not len(left):
                break
        if len(left):
            raise ValueError("pieces cannot be told apart")
        # a bit by hash for all that a longer piece begins with; others may set it too
        self.begins = np.zeros(1 << self.bits, bool)
        heads = {p[:i] for p in names for i in range(1, len(p))}
        self.begins[self._slot(np.array([self._hash(p) for p in heads], np.uint64), 0)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c)) * int(_BASE)) & ((1 << 64) - 1)
        return h

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return (scan.mix(keys + np.uint64(turn)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def goes_on(self, keys: np.ndarray) -> np.ndarray:
        return self.begins[self._slot(keys, 0)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        for turn, (key, at) in enumerate(self.tables):
            slot = self._slot(keys, turn)
            out = np.where((key[slot] == keys) & (at[slot] >= 0), at[slot], out)
        return out


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    return Pieces(path)


def _lattices(pieces: Pieces, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Words of one length at a time: which words, their length, and for each span
    (begin, end) the words that have a piece there, and it. The piece of a single
    letter that is none is ``pieces.size``."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == length)
        grid = codes[first[which][:, None] + np.arange(length)]
        edges = []
        # spans of one size, by begin and word: those that some piece begins with
        begin, row = np.repeat(np.arange(length), len(which)), np.tile(np.arange(len(which)), length)
        hashes = grid.T.ravel() * _BASE
        for size in range(1, length + 1):
            found = pieces.find(hashes)
            if size == 1:
                found[found < 0] = pieces.size
            at = np.flatnonzero(found >= 0)
            bounds = np.searchsorted(begin[at], np.arange(length + 1)).tolist()
            for b in range(length - size + 1):
                if bounds[b] < bounds[b + 1]:
                    own = at[bounds[b] : bounds[b + 1]]
                    edges.append((b, b + size, row[own], found[own]))
            on = np.flatnonzero(pieces.goes_on(hashes) & (begin + size < length))
            if not len(on):
                break
            begin, row = begin[on], row[on]
            hashes = (hashes[on] + grid[row, begin + size]) * _BASE
        edges.sort(key=lambda e: e[1])
        yield which, length, edges


def word_scores(pieces: Pieces, model: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language; ``model`` has a row per piece,
    one more for letters that are none, and a column per language."""
    out = np.zeros((len(words), model.shape[1]))
    for at in range(0, len(words), WORDS):
        for which, length, edges in _lattices(pieces, words[at : at + WORDS]):
            # sums of the last places by end, each place scaled so that it sums to 1
            recent, log = {0: np.ones((len(which), model.shape[1]))}, np.zeros((len(which), model.shape[1]))
            for end, own in groupby(edges, key=lambda e: e[1]):
                new = np.zeros_like(log)
                for begin, _, rows, ids in own:
                    new[rows] += recent[begin][rows] * model[ids]
                log += np.log(new)
                for begin in [b for b in recent if b <= end - pieces.longest]:
                    del recent[begin]
                for sums in recent.values():
                    sums /= new
                recent[end] = np.ones_like(log)
            out[at + which] = log
    return out


def _long_score(pieces: Pieces, model: np.ndarray, word: str) -> np.ndarray:
    """The same for one word of any length, a row of the lattice at a time."""
    codes, total = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(model.shape[1])
    recent = [np.ones(model.shape[1])]  # forward sums of the last places, newest last
    for end in range(1, len(codes) + 1):
        back = min(end, pieces.longest)
        keys = np.empty(back, np.uint64)
        for k in range(back):  # a piece of k + 1 letters that ends here
            h = np.uint64(0)
            for c in codes[end - 1 - k : end]:
                with np.errstate(over="ignore"):
                    h = (h + c) * _BASE
            keys[k] = h
        ids = pieces.find(keys)
        if ids[0] < 0:
            ids[0] = pieces.size
        new = sum(recent[-1 - k] * model[i] for k, i in enumerate(ids.tolist()) if i >= 0)
        recent = [r / new for r in recent[-pieces.longest :]] + [np.ones(model.shape[1])]
        total += np.log(new)  # each language by its own sum, so none runs out of range
    return total


def _spell(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of the documents of a batch."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t"), strict=True):
            counts.setdefault(lang, Counter()).update(_spell(text.as_py()))
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                ["lang", "word", "n"],
            )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``WORDS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _scaled_sums(sums: np.ndarray, power: np.ndarray, at: int, steps: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """The sums of a place from those of others (place, words, probabilities), all
    scaled by the power of the largest one so that no place runs out of range."""
    most = np.full(sums.shape[1], np.iinfo(np.int32).min, np.int32)
    for other, rows, _ in steps:
        most[rows] = np.maximum(most[rows], power[other][rows])
    for other, rows, p in steps:
        sums[at][rows] += np.ldexp(sums[other][rows] * p, power[other][rows] - most[rows])
    sums[at], own = np.frexp(sums[at])
    power[at] = most + own


def _expected(path: str, langs: list[str], model: np.ndarray | None):
    """Expected uses (lang, piece, uses) over all segmentations of each word, or
    with no model yet, over all places where a piece fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number = load(path), {lang: i for i, lang in enumerate(langs)}
        rows_ = pieces.size + 1
        uses = np.zeros(rows_ * len(langs))
        flat = None if model is None else np.ascontiguousarray(model.T).ravel()
        for batch in _gathered(batches):
            # a very long word is learned from in blocks
            cut = [["▁" + w] if len(w) < _LONG else [("▁" + w)[i : i + _LONG] for i in range(0, len(w) + 1, _LONG)] for w in batch.column("word").to_pylist()]
            words, times = [x for block in cut for x in block], [len(block) for block in cut]
            n = np.repeat(batch.column("n").to_numpy().astype(float), times)
            base = np.repeat(np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64) * rows_, times)
            for which, length, edges in _lattices(pieces, words):
                of, weight = base[which], n[which]
                if flat is None:
                    for _, _, rows, ids in edges:
                        uses += np.bincount(of[rows] + ids, weight[rows], len(uses))
                    continue
                prob = [flat[of[rows] + ids] for _, _, rows, ids in edges]
                # every place scaled by a power of two, and so told exactly: alpha and
                # beta at a place stand for themselves times two to ``up`` and ``down``
                shape = (length + 1, len(which))
                alpha, beta, up, down = np.zeros(shape), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
                alpha[0] = beta[length] = 1
                forth = list(zip(edges, prob, strict=True))
                for end, own in groupby(forth, key=lambda x: x[0][1]):
                    _scaled_sums(alpha, up, end, [(b, rows, p) for (b, _, rows, _), p in own])
                for begin, own in groupby(sorted(forth, key=lambda x: -x[0][0]), key=lambda x: x[0][0]):
                    _scaled_sums(beta, down, begin, [(e, rows, p) for (_, e, rows, _), p in own])
                share = weight / alpha[length]
                at = np.concatenate([of[rows] + ids for _, _, rows, ids in edges])
                by = np.concatenate([
                    share[rows] * np.ldexp(alpha[b][rows] * p * beta[e][rows], up[b][rows] + down[e][rows] - up[length][rows])
                    for (b, e, rows, _), p in forth
                ])
                uses += np.bincount(at, by, len(uses))
        found = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found // rows_), pa.array(found % rows_), pa.array(np.rint(uses[found] * _FRACTION).astype(np.int64))],
            ["lang", "piece", "uses"],
        )

    return run


def train(labelled: DataFrame, path: str, steps: int = STEPS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log of their shares, and piece probabilities (piece, language) of
    (t, lang) rows."""
    shares = dict(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect())
    langs = sorted(shares)
    counts = labelled.mapInArrow(_counted, "lang string, word string, n long")
    counts = materialise(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pieces, model = load(path), None
    for _ in range(steps + 1):
        uses = counts.mapInArrow(_expected(path, langs, model), "lang long, piece long, uses long")
        told = uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.full((pieces.size + 1, len(langs)), PRIOR_USES)
        total[told["piece"].to_numpy(), told["lang"].to_numpy()] += told["uses"].to_numpy() / _FRACTION
        model = total / total.sum(axis=0)
    log_shares = np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values())))
    return langs, log_shares, model


def _predicted(path: str, langs: list[str], log_shares: np.ndarray, model: np.ndarray):
    def some(texts: list[str]) -> tuple[list[str], np.ndarray]:
        number: dict[str, int] = {}
        spelled = [[number.setdefault(w, len(number)) for w in _spell(t)] for t in texts]
        known = np.array([any(c.isalpha() for c in w) for w in number] or [False])
        scores = word_scores(load(path), model, ["▁" + w for w in number])
        best, sure = [], np.zeros(len(texts))
        for i, ids in enumerate(spelled):
            if not ids or not known[ids].any():
                best.append(UNKNOWN)
                continue
            whole = log_shares + scores[ids].sum(axis=0)
            whole = np.exp(whole - whole.max())
            best.append(langs[int(whole.argmax())])
            sure[i] = round(float(whole.max() / whole.sum()), 6)
        return best, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column("t").to_pylist()
                best, sure = some(texts) if langs else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                keep = [n for n in part.schema.names if n != "t"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in keep), pa.array(best, pa.string()), pa.array(sure)], [*keep, "lang_pred", "score"]
                )

    return run


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def languages(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, whether it was held out from learning, the
    language found and the posterior of it."""
    path = _path(path)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("t"), docs[lang_col].alias("lang"))
    learned = rows.filter("NOT held_out AND lang IS NOT NULL").select("t", "lang")
    langs, log_shares, model = train(learned, path)
    asked = rows.select("doc_id", "held_out", "t")
    form = f"doc_id {asked.dtypes[0][1]}, held_out boolean, lang_pred string, score double"
    return asked.mapInArrow(_predicted(path, langs, log_shares, model), form)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return languages(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2)
