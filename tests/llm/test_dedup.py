import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronolode.llm import exact_dedup, near_dedup, substring_dedup, tiles
from chronolode.llm.components import components
from tests.llm import brute


def text_of(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(30)) for _ in range(n))


def edited(r, text, share):
    return " ".join("x" + str(r.randrange(10**6)) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def family():
    """Near copies of all degrees, exact copies, passages, odd texts."""
    r = random.Random(5)
    rows, n = [], 0
    passage = text_of(r, 50)
    for size in (3, 5, 8, 30, 120, 400):
        base = text_of(r, size)
        for share in [0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08] * 2:
            rows.append((n, edited(r, base, share)))
            n += 1
    base = text_of(r, 90)
    for _ in range(150):
        rows.append((n, edited(r, base, r.random() * 0.06)))
        n += 1
    for _ in range(40):
        rows.append((n, text_of(r, r.randrange(40)) + " " + passage + " " + text_of(r, r.randrange(40))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "é ü " * 30), (n + 6, "a " * 5000), (n + 7, "a " * 700)]
    return rows


def test_near_equals_brute_force(docs, family):
    got = near_dedup.near_duplicates(docs(family)).collect()
    want = brute.near(family)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_other_settings(docs, family):
    got = near_dedup.near_duplicates(docs(family), percent=90, k=32).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(family, 90)


def test_near_filter_keeps_rows_whole(docs, family):
    df = docs(family)
    got = near_dedup.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c in brute.near(family).values()})


def test_near_repeated_rows_and_null_ids(docs):
    text = "one two three four five six"
    got = near_dedup.near_duplicates(docs([(1, text), (1, text), (None, text), (None, "other"), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1)]
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles == 2] == [1]
    assert near_dedup.without_near_duplicates(docs([(1, text), (1, text)])).count() == 1


def test_sure_overlap_is_a_lower_bound():
    assert near_dedup.sure_overlap(1, 75) == 1
    assert 20 < near_dedup.sure_overlap(64, 75) < 48


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {}
    for a, b in pairs:
        root.setdefault(a, a)
        root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    want = {x: m for x, m in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert got == want


@pytest.mark.parametrize("hot", [2, 2000])
def test_passages_equal_brute_force(docs, family, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 2000 if hot == 2000 else 10_000_000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    r = random.Random(8)
    long = text_of(r, 300)
    rows = family + [(9000, long + "\t" + long), (9001, "b " * 500), (9001, "b " * 500), (9002, long[:40].upper())]
    got = sorted((tuple(x) for x in substring_dedup.passage_removal(docs(rows), window=12).collect()), key=repr)
    assert got == brute.passages(rows, 12)


def test_passages_leave_columns(docs):
    words = " ".join(f"w{i}" for i in range(50))
    df = docs([(1, "start " + words), (2, words + "\nend"), (3, None)])
    got = substring_dedup.without_passages(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "start", 2: "end", 3: ""}


def test_automaton_matches():
    r = random.Random(1)
    for _ in range(200):
        refs = [[r.choice("abc") for _ in range(r.randrange(1, 15))] for _ in range(3)]
        auto = substring_dedup.Automaton()
        for x in refs:
            auto.add(x)
        words = [r.choice("abc") for _ in range(25)]
        inside = {tuple(x[i : i + 4]) for x in refs for i in range(len(x) - 3)}
        want = {k for j in range(22) if tuple(words[j : j + 4]) in inside for k in range(j, j + 4)}
        assert {k for a, b in auto.covered(words, 4) for k in range(a, b)} == want


def test_exact(docs):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (None, "a"), (6, "x" * 300_000), (6, "x" * 300_000)]
    got = exact_dedup.exact_duplicates(docs(rows), keep="largest").collect()
    want = {}
    for i, t in rows:
        want.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = want[next(t or "" for i, t in rows if i == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.without_duplicates(docs(rows), keep="largest").collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 5, 6]
    small = exact_dedup.without_duplicates(docs([(2, "a"), (1, "a"), (3, "b")]), keep="smallest")
    assert sorted(r.doc_id for r in small.collect()) == [1, 3]


def test_exact_tells_collisions_apart(docs):
    rows = [(i, f"t{i % 7}") for i in range(30)]
    got = exact_dedup.exact_duplicates(docs(rows), keep="largest", hashed=lambda t: F.unhex(F.lit("00"))).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: max(j for j in range(30) if j % 7 == i % 7) for i in range(30)}


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.without_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == near_dedup.without_near_duplicates(empty).count() == 0
    assert substring_dedup.passage_removal(empty).count() == 0


def test_near_texts_that_share_much_are_no_candidates(docs, monkeypatch):
    """Texts of 4000 words that share three fifths of them meet in many lists; tiles
    leave few pairs of them, each told once."""
    r = random.Random(9)
    base = text_of(r, 4000).split(" ")
    rows = [(i, " ".join(base[:2400] + text_of(r, 1600).split(" "))) for i in range(120)]
    told = []

    def counted(members, percent):
        pairs = tiles.similar_pairs(members, percent)
        told.append((pairs.count(), members.count()))
        return pairs

    monkeypatch.setattr(near_dedup, "similar_pairs", counted)
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)
    assert told[0][1] > 120 and told[0][0] < 500


def test_near_last_round_alone_in_small_tiles(docs, family, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "similar_pairs", lambda members, percent: tiles.similar_pairs(members, percent, 20))
    got = near_dedup.near_duplicates(docs(family)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(family)


def test_near_very_long_text(docs):
    r = random.Random(10)
    long = text_of(r, 200_000)
    rows = [(1, long), (2, edited(r, long, 0.01)), (3, edited(r, long, 0.2))]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows)
