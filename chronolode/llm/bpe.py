"""BPE encoding as a bounded-lookahead transducer, and decoding as a state machine.

The merge list alone says how far right a token boundary can depend on the text.
A boundary before ``r`` changes only if some rule ``(l, r)`` is stopped or let
through because the end of ``r`` was taken by an earlier rule ``(a, b)``, ``a`` being
a part of ``r`` at its right end; that one in turn depends on what follows ``b``.
The longest such chain, found in one pass over the rules in their order, is the
sufficient lookahead: with that many symbols to its right, a token is stable and
is emitted. A word of any length is so encoded in constant memory, and a text in
memory beyond the text itself that does not grow with it.

Decoding appends the bytes of each token to an incremental UTF-8 decoder, which
holds back at most the bytes of one unfinished character.

Tokenizer files are those of the ``tokenizers`` library with a BPE model over
byte symbols, a word-end suffix, white space dropped between words, and special
tokens found in the raw text.

Defined results: a null text is empty and has no tokens, rows that repeat and
other columns pass through untouched, an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.common import packed, table

#: Characters of text handled at once, symbols fed at once, and words remembered.
SLICE, FEED, REMEMBERED = 1 << 16, 256, 150_000
#: White space of the tokenizer's patterns; str.split() also takes \x1c-\x1f.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ID = 20
_MASK, _NONE = (1 << _ID) - 1, 1 << 62
_SPACES, _ODD = re.compile(f"[{_SPACE}]+"), re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the
    others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list over symbols, as a transducer.

    rules: (left, right, merged) in order of priority; size: symbols of a token.
    """

    def __init__(self, rules: Iterable[tuple[int, int, int]], size: dict[int, int]) -> None:
        rules = list(rules)
        # a pair of ids in one number, to the rule's place and what it makes in one
        self.rank = {a << _ID | b: i << _ID | m for i, (a, b, m) in reversed(list(enumerate(rules)))}
        self.lookahead = self._lookahead(rules, size)
        self.size = size

    @staticmethod
    def _lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
        ends: dict[int, set[int]] = {}  # of a token: itself and the parts at its right end
        reach: dict[int, int] = {}  # of the rules so far, by left part
        longest = 0
        for a, b, merged in rules:
            of_b = ends.setdefault(b, {b})
            own = size[b] + max(reach.get(x, 0) for x in of_b)
            reach[a] = max(reach.get(a, 0), own)
            longest = max(longest, own)
            ends.setdefault(merged, {merged}).update(of_b)
        return longest

    def merged(self, tokens: list[int]) -> list[int]:
        """All merges applied: the first rule that fits, leftmost place first."""
        rank = self.rank.get
        pairs = [rank(a << _ID | b, _NONE) for a, b in zip(tokens, tokens[1:], strict=False)]
        while pairs and (best := min(pairs)) < _NONE:
            i = pairs.index(best)
            tokens[i] = made = best & _MASK
            del tokens[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(tokens[i - 1] << _ID | made, _NONE)
            if i < len(pairs):
                pairs[i] = rank(made << _ID | tokens[i + 1], _NONE)
        return tokens

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of the symbols, each as soon as it is stable; the end of the word
        settles those still held."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.lookahead + FEED:
                tokens = self.merged(held.copy())
                sure, at, out = len(held) - self.lookahead, 0, 0
                while at + self.size[tokens[out]] <= sure:
                    at += self.size[tokens[out]]
                    out += 1
                yield from tokens[:out]
                # a stable boundary splits the text: what is right of it starts anew
                del held[:at]
        yield from self.merged(held)


class Decoder:
    """Ids to text, any number at a time."""

    def __init__(self, pieces: list[bytes], between: bytes) -> None:
        self._pieces, self._between, self._first = pieces, between, True
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self._between.join(map(self._pieces.__getitem__, ids))
        if data and not self._first:
            data = self._between + data
        self._first = self._first and not data
        return self._state.decode(data)

    def close(self) -> str:
        return self._state.decode(b"", final=True)


class Tokenizer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], told["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in told["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["unk_token"] or told["decoder"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a tokenizer of the kind described above")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.vocab_size = 1 + max(*vocab.values(), *(t["id"] for t in told["added_tokens"]))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", _SPACE), regex.VERSION0)
        names = byte_symbols()
        self._inner, self._last = [vocab[c] for c in names], [vocab[c + self.suffix] for c in names]
        size = {i: len(t.removesuffix(self.suffix)) for t, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), size)
        self.text_of = [b""] * self.vocab_size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = t.encode()
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _tokens(self, piece: str) -> Iterable[int]:
        """Tokens of one piece: a short one is over before anything could be emitted."""
        data = piece.encode()
        symbols = [self._inner[b] for b in data]
        symbols[-1] = self._last[data[-1]]
        return self.merges.merged(symbols) if len(symbols) < FEED else self.merges.stream(symbols)

    def _word(self, word: str) -> bytes:
        """Ids of a word between white space, as bytes; words of usual length are
        remembered, in two generations of which the older one is dropped."""
        found = self._new.get(word) or self._old.get(word)
        if found is None:
            ids = [i for p in self._pieces.findall(word) for i in self._tokens(p)]
            found = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self._new) >= REMEMBERED:
                self._old, self._new = self._new, {}
            self._new[word] = found
        return found

    def _plain(self, text: str) -> Iterator[bytes]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = [w for w in _SPACES.split(text) if w] if _ODD.search(text) else text.split()
        known, found = self._new.get, self._word
        yield b"".join([known(w) or found(w) for w in words])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit numbers, a slice of the text at a time. Slices
        begin at white space, which joins with nothing."""
        for part in self._special.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                cut = _SPACES.search(part, at + SLICE)
                to = cut.start() if cut else len(part)
                yield from self._plain(part[at:to])
                at = to

    def decoder(self) -> Decoder:
        return Decoder(self.text_of, b" ")


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """One tokenizer per worker and file."""
    return Tokenizer(path)


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            number, of_ids, of_text, all_ids = [], [], [], []
            for text in batch.column("t"):
                ids_hash, text_hash, decoder, n, own = hashlib.sha256(), hashlib.sha256(), tokenizer.decoder(), 0, []
                for ids in tokenizer.encode(text.as_py()):
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    values = np.frombuffer(ids, "<u4")
                    text_hash.update(decoder.feed(values.tolist()).encode())
                    if with_ids:
                        own.append(values)
                text_hash.update(decoder.close().encode())
                number.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
                if with_ids:
                    all_ids.append(np.concatenate([np.zeros(0, "<u4"), *own]).astype(np.int32))
            columns = [pa.array(number, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            keep = [n for n in batch.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns], [*keep, *names])

    return run


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, the number of tokens, and digests of the
    ids and of the text decoded from them."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    return rows.mapInArrow(_digests(_path(path), False), f"doc_id {rows.dtypes[0][1]}, {_DIGESTS}")


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text in ``ids`` and their digests, in place
    of columns of these names."""
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    rows = packed(docs, t=F.coalesce(docs[text_col], F.lit("")))
    out = rows.mapInArrow(_digests(_path(path), True), f"row {rows.dtypes[0][1]}, {_DIGESTS}, ids array<int>")
    return out.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def decoded(tokens: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with the text of the ids in ``decoded``."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                state = load(path).decoder()
                texts.append(state.feed(ids.as_py() or ()) + state.close())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    rows = packed(tokens, ids=tokens[ids_col])
    out = rows.mapInArrow(run, f"row {rows.dtypes[0][1]}, decoded string")
    return out.select("row.*", "decoded")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))
