"""Words of many texts at once, as arrays over the bytes of an Arrow column.

Words are what stands between the bytes ``\\x20`` and ``\\x09-\\x0D``; all of these
are single bytes in UTF-8, so texts need not be decoded. A word's hash comes from
running sums over its bytes, each a random 64-bit value of the byte times a power
of an odd base; sums differ between two places by the word's own part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; only a longer single text takes more.
PART = 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEPS = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                for b in (_BASE, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Words:
    """The words of some texts, one after the other.

    data: bytes of all texts; start, end: of each word in it; text: number of the
    text it is in; first: for each text its first word, and the number of words.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _POWERS.first(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def runs(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``length`` words within a text, and its first word."""
        n = len(hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for j in range(length):
            out += hashes[j : j + n] * _STEPS[j]
        at = np.flatnonzero(self.text[:n] == self.text[length - 1 :])
        return mix(out[at]), at


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts whose bytes lie between neighbouring offsets."""
    if lower:
        data = _LOWER[data]
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_GAP[data], out=inside[1:-1])
    here = inside[1:-1]
    begins, ends = here & ~inside[:-2], here & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = here[edge]
    ends[edge - 1] = here[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, text, first)


def parts(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column without nulls, each of few bytes: the rows they
    hold, their bytes, and offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, held = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A column of lists from all their values in a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
