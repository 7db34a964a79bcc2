"""Token counts of whole texts; huge ones by overlapping chunks that resynchronise.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is cut into
chunks that overlap, each encoded with offsets. Two neighbours are spliced at a
place in their overlap that is a token boundary in both and provably one in the
whole text: the pattern that splits text before merging never joins a letter, a
number or another visible character to a white space after it, nor a letter or
number to a character of another kind after it, whatever stands to the left, and
no token crosses a split. Such a place must not lie in the string of a special
token. Where an overlap holds no such place it is doubled and encoded again, up
to the end of the text. So the memory taken follows the chunk, not the text.

Defined results: a null text is empty and has no tokens, repeated rows count
each, an empty table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.bpe import _SPACE
from chronolode.llm.common import table

#: Characters of a chunk and of an overlap, and of the texts encoded together.
CHUNK, OVERLAP, TOGETHER = 1 << 16, 512, 1 << 18
LIMIT = 1024

#: Places that are split whatever is to their left.
_PLACES = regex.compile(rf"(?<=\p{{L}})(?!\p{{L}})|(?<=\p{{N}})(?!\p{{N}})|(?<=[^{_SPACE}\x1c-\x1f])(?=[{_SPACE}])")


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Token counts by one tokenizer."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.widest = max(map(len, self.special), default=0)

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        encoding = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return [begin + a for a, _ in encoding.offsets]

    def _in_special(self, text: str, at: int) -> bool:
        around = text[max(0, at - self.widest + 1) : at + self.widest - 1]
        before = at - max(0, at - self.widest + 1)
        return any(
            0 <= (i := around.find(s)) < before < i + len(s) or 0 <= (i := around.rfind(s)) < before < i + len(s)
            for s in self.special
        )

    def _splice(self, text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
        """The first place between begin and end where both may be cut."""
        both = set(left) & set(right)
        for m in _PLACES.finditer(text, begin + 1, end):
            if m.start() in both and m.start() < end and not self._in_special(text, m.start()):
                return m.start()
        return None

    def long(self, text: str) -> int:
        """Tokens of a text of any length. ``left`` holds the token starts of the chunk
        in hand, of which those from ``done`` on are not yet counted."""
        size, total, done = len(text), 0, 0
        at, overlap = self.chunk, self.overlap
        left = self._starts(text, 0, min(size, at + overlap))
        while at + overlap < size:
            right = self._starts(text, at, min(size, at + self.chunk + overlap))
            cut = self._splice(text, left, right, at, at + overlap)
            if cut is None:  # widen: the chunk in hand reaches further, the next one starts the same
                overlap *= 2
                left = self._starts(text, done, min(size, at + overlap))
                continue
            total += sum(done <= s < cut for s in left)
            done, left = cut, right
            at, overlap = at + self.chunk, self.overlap
        return total + sum(done <= s for s in left)

    def counts(self, texts: list[str]) -> list[int]:
        out, held, chars = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = self.long(text)
                continue
            held.append(i)
            chars += len(text)
            if chars > TOGETHER:
                self._short(texts, held, out)
                held, chars = [], 0
        self._short(texts, held, out)
        return out

    def _short(self, texts: list[str], which: list[int], out: list[int]) -> None:
        encodings = self.tokenizer.encode_batch_fast([texts[i] for i in which], add_special_tokens=False)
        for i, e in zip(which, encodings, strict=True):
            out[i] = len(e)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``docs``: its id, bytes, tokens, and whether these exceed
    ``limit``."""
    path = _path(path)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                counts = pa.array(counter.counts(some.column("t").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
