import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolode.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, i string, depth string, bytes string, digest string, h string"


@pytest.fixture
def turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], SCHEMA)

    return make


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """The nodes by their whole sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seq[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def talk(r, convs, first=0):
    """Conversations of few different turns, so that beginnings meet."""
    out = []
    for c in range(first, first + convs):
        for t in range(r.randrange(1, 14)):
            out.append((c, t, ("user", "assistant")[t % 2], r.choice(["yes", "no", "é"]) if r.random() < 0.9 else r.choice([None, "", "long " * 50])))
    return out


def test_equals_whole_sequences(turns):
    r = random.Random(1)
    rows = talk(r, 300)
    rows = [x for x in rows if x[0] % 35]  # some families without a head
    rows += [(-c, t, role, text) for c, t, role, text in talk(r, 20, 1)]
    r.shuffle(rows)
    assert rows_of(trie.prefix_trie(turns(rows))) == plain(rows)


def test_nulls_ties_and_repeated_rows(turns):
    rows = [(4, None, "user", "a"), (4, None, None, "b"), (4, 1, "user", None), (4, 1, "user", None), (5, None, None, None)]
    rows += [(None, 0, "user", "lost"), (10, 3, "", ""), (10, 3, "user", "x"), (10, 3, "assistant", "x"), (12, 1, "us", "er"), (13, 1, "user", "")]
    assert rows_of(trie.prefix_trie(turns(rows))) == plain(rows)


def test_empty(turns):
    assert trie.prefix_trie(turns([])).collect() == []
    assert trie.prefix_trie(turns([(None, 1, "user", "x")])).collect() == []


def test_long_conversations_over_partitions_and_blocks(turns, partitions, monkeypatch):
    """Two equal long conversations with very long texts, cut into many partitions and
    blocks."""
    monkeypatch.setattr(trie, "DEPTHS", 16)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    r = random.Random(2)
    words = [str(r.random()) for _ in range(150)]
    rows = [(c, t, "user", words[t] * (2000 if t == 40 else 1)) for c in (5, 6, 20) for t in range(150)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    want = plain(rows)
    for n in (1, 7, 40):
        partitions(n)
        assert rows_of(trie.prefix_trie(turns(rows))) == want


def test_products_compose():
    r = random.Random(3)
    maps = [(r.randrange(1, trie.PRIME), r.randrange(trie.PRIME)) for _ in range(20)]
    whole = (1, 0)
    for m in maps:
        whole = trie.combined(whole, m)
    left, right = (1, 0), (1, 0)
    for m in maps[:8]:
        left = trie.combined(left, m)
    for m in maps[8:]:
        right = trie.combined(right, m)
    assert trie.combined(left, right) == whole and trie.combined(trie.inverse(left), whole) == right
    assert trie.combined(maps[0], maps[1]) != trie.combined(maps[1], maps[0])


def test_colliding_digests_are_found(turns):
    """A first digest that is one for all turns of a role is given up for another."""
    rows = talk(random.Random(4), 40)

    def weak(role, text, salt):
        return trie.turn_digest(role, F.lit("") if salt < 2 else text, 0)

    assert rows_of(trie.prefix_trie(turns(rows), digest=weak)) == plain(rows)
    with pytest.raises(RuntimeError):
        trie.prefix_trie(turns(rows), digest=lambda role, text, salt: trie.turn_digest(role, F.lit(""), salt))
