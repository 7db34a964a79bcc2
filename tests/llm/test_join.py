import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolode.llm import ngram_join, tiles
from chronolode.llm.ngram_join import leading, ngram_links
from tests.llm import brute
from tests.llm.test_dedup import edited, family, text_of  # noqa: F401


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(docs, family):  # noqa: F811
    assert result(ngram_links(docs(family))) == brute.near(family, 85, 4)


def test_other_settings(docs, family):  # noqa: F811
    assert result(ngram_links(docs(family), length=2, percent=60)) == brute.near(family, 60, 2)


@pytest.mark.parametrize("block", [3, 40])
def test_last_round_alone_in_small_blocks(docs, family, monkeypatch, block):  # noqa: F811
    """Without rounds of stars every list goes through tiles, cut into many blocks."""
    monkeypatch.setattr(ngram_join, "STARS", 0)
    monkeypatch.setattr(ngram_join, "similar_pairs", lambda members, percent: tiles.similar_pairs(members, percent, block))
    assert result(ngram_links(docs(family))) == brute.near(family, 85, 4)


def test_very_long_text(docs):
    r = random.Random(3)
    long = text_of(r, 300_000)
    rows = [(1, long), (2, edited(r, long, 0.01)), (3, edited(r, long, 0.2)), (4, text_of(r, 200_000))]
    assert result(ngram_links(docs(rows))) == brute.near(rows, 85, 4)


def test_no_table_and_odd_rows(docs, empty):
    assert ngram_links(empty).collect() == []
    text = "one two three four five six"
    got = ngram_links(docs([(1, text), (1, text), (None, text), (None, "other"), (None, None), (7, "")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (7, 7)]
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles == 3] == [1]


def test_large_group_of_near_copies_makes_few_candidates(docs, spark):
    """Copies too far from each other to link stay in their tiles."""
    r = random.Random(5)
    base = text_of(r, 4000)
    rows = [(i, " ".join(w if r.random() < 0.6 else str(r.random()) for w in base.split(" "))) for i in range(60)]
    rows += [(100 + i, edited(r, base, 0.03)) for i in range(100)]  # a fifth of the n-grams differs
    members = []
    for i, t in rows:
        data = t.encode()
        s = next(iter(ngram_join.ngram_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 4)))
        members.append((1, i, i, len(s), len(s), tiles.bitmap(s).tolist()))
    df = spark.createDataFrame(members, "h long, node long, root long, n long, room long, bits array<long>")
    assert tiles.similar_pairs(df, 85, 16).count() < 100
    short = df.withColumn("bits", tiles.folded(F.col("bits")))
    assert short.filter("size(bits) = 8").count() == 160
    wide = {m[1]: np.array(m[5]) for m in members}
    for x in short.collect():
        assert (np.bitwise_xor.reduce(wide[x.node].reshape(-1, 8)) == x.bits).all()
    assert result(ngram_links(docs(rows))) == brute.near(rows, 85, 4)


def test_bands_hold_all_sizes_that_can_link():
    for percent in (50, 75, 85, 99):
        edges = tiles.band_edges(percent, 5000)
        band = np.searchsorted(edges, np.arange(1, 3000), "right")
        for a in range(1, 1500):
            b = min(100 * a // percent, 2999)
            assert band[b - 1] - band[a - 1] <= 1


def test_leading_values_hold_a_shared_one():
    """The least overlap of similar sets leaves no room outside the leading values."""
    for percent in (50, 75, 85):
        for n in range(1, 300):
            for m in range(n, 100 * n // percent + 1):
                least = -(-percent * (n + m) // (100 + percent))
                assert (n - leading(n, percent)) < least and (m - leading(m, percent)) < least


def test_bitmaps_never_understate_the_overlap():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 1 << 63, int(n), dtype=np.uint64) for n in r.integers(100, 900, 30)]
    sets += [np.concatenate([s[: len(s) // 2], r.integers(0, 1 << 63, 60, dtype=np.uint64)]) for s in sets]
    bits = tiles.Bitmaps(pa.array([tiles.bitmap(s).tolist() for s in sets], pa.list_(pa.int64())))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    differ = bits.differ(i, bits, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    size = np.array([[len(sets[a]), len(sets[b])] for a, b in zip(i, j, strict=True)])
    close = (true < 0.3 * size.sum(1)) & (size.min(1) > 0.8 * size.max(1))
    assert (differ <= true).all() and (differ[close] >= 0.7 * true[close]).all()
