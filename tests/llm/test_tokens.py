import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolode.llm import bpe, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  ", "It's <|endoftext|> we'll ΟΔΟΣ ΣΣ İstanbul ½²³ cafe\u0301 \x1c\x1f \x85 \xa0x ﬁ 漢字 🎉🎉 <|startoftext|><|ENDOFTEXT|>",
    "a" * 3000, "ab" * 2000 + "thethethe" * 500, "x" * 700 + " <|endoftext|> " + "!" * 900, "'s" * 300, "1２Ⅷ٣" * 40, "\n\n \t" * 50,
]


def texts():
    r = random.Random(3)
    out = list(ODD)
    for _ in range(300):
        out.append("".join(r.choice(["a", "b", " ", "'s", "'t", "x", " the", "\n", "<|endoftext|>", "|", "é", "漢", "1", "２", "\u2003", "  ", "\x1c", "!?", "\xa0", "İ", "Σ", "\u0301"]) for _ in range(r.randrange(120))))
    return out


def test_encoding_and_decoding_equal_the_library(docs):
    rows = [*enumerate(texts()), (9000, None)]
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.token_digests(docs(rows)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoded_keeps_columns_and_decodes(docs, empty):
    df = docs([(1, "The thing"), (1, "The thing"), (2, None)])
    out = bpe.encoded(df)
    assert out.columns == [*df.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    back = bpe.decoded(out).collect()
    library = Tokenizer.from_file(WORD)
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in [(1, "The thing"), (1, "The thing"), (2, "")])
    assert bpe.encoded(empty).count() == bpe.token_digests(empty).count() == 0


def naive(rules, tokens):
    """Merges by the definition: the first rule that fits, leftmost."""
    tokens = list(tokens)
    while True:
        found = next(((m, i) for a, b, m in rules for i in range(len(tokens) - 1) if (tokens[i], tokens[i + 1]) == (a, b)), None)
        if found is None:
            return tokens
        tokens[found[1] : found[1] + 2] = [found[0]]


@st.composite
def merge_lists(draw):
    size, rules = {i: 1 for i in range(3)}, []
    for _ in range(draw(st.integers(1, 9))):
        a, b = draw(st.sampled_from(sorted(size))), draw(st.sampled_from(sorted(size)))
        if not any((a, b) == r[:2] for r in rules):
            new = len(size)
            rules.append((a, b, new))
            size[new] = size[a] + size[b]
    return rules, size


@settings(max_examples=300, deadline=None)
@given(merge_lists(), st.lists(st.integers(0, 2), max_size=60))
def test_lookahead_suffices(made, symbols):
    """Tokens given out early are those of the whole word, for any merge list."""
    rules, size = made
    merges = bpe.Merges(rules, size)
    before, bpe.FEED = bpe.FEED, 1
    try:
        assert list(merges.stream(symbols)) == naive(rules, symbols)
    finally:
        bpe.FEED = before


def test_memory_of_the_transducer_is_bounded():
    t = bpe.load(WORD)
    fed = 0

    def symbols():
        nonlocal fed
        for _ in range(20_000):
            fed += 1
            yield t._inner[97 + fed % 7]

    ahead = 0
    out = 0
    for token in t.merges.stream(symbols()):
        out += t.merges.size[token]
        if fed < 20_000:
            ahead = max(ahead, fed - out)
    assert out == 20_000 and ahead <= t.merges.lookahead + bpe.FEED + max(t.merges.size.values())


def test_decoder_in_pieces():
    state = bpe.Decoder([b"\xc3", b"\xa9", b"a"], b"")
    assert [state.feed([0]), state.feed([1]), state.feed([2, 0]), state.close()] == ["", "é", "a", "\ufffd"]


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (200, 16), (1 << 16, 512)])
def test_counts_equal_the_library(chunk, overlap):
    library = Tokenizer.from_file(BYTE)
    counter = token_counts.Counter(BYTE, chunk, overlap)
    some = texts()
    assert counter.counts(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_counts_of_a_table(docs, empty):
    rows = [(1, "word " * 30_000), (2, None), (2, "é"), (3, "a" * 200_000)]
    library = Tokenizer.from_file(BYTE)
    got = token_counts.token_counts(docs(rows)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(empty).count() == 0
