import hashlib
import random

import numpy as np
import pytest

from chronolode.llm import centroids
from chronolode.llm.centroids import candidates, centroid_clusters, centroid_report, distances, hilbert

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, cluster string, place long"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 0, "x", 1, "y", 2) for r in rows], SCHEMA)

    return make


def plain(rows, k, rounds, dim=64, salt="2"):
    """{(id, place in rows): (cluster, distance, cluster sum, digest)} and the sum."""
    kept = []
    for n, (i, e) in enumerate(rows):
        if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, n, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in e)))
    digest = lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, digest(r[0])), r[2]))[:k]
    c = [list(r[2]) for r in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, own in groups.items():
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, v, *reversed(near(v))) for i, _, v in kept]
    total = {}
    for _, _, j, d in out:
        total[j] = total.get(j, 0) + d
    text = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, total[j], sum(total.values()), text[j]) for i, _, j, d in out), key=repr)


def rows_of(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_equals_plain_rounds(vectors):
    r = np.random.default_rng(3)
    middle = r.normal(size=(7, 64))
    rows = [(i, (middle[i % 7] + r.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(7, rows[7][1])] * 3  # one vector often, rows again
    odd = list(rows[0][1])
    rows += [(2000, None), (2001, []), (2002, odd[:63]), (2003, [*odd, 0.0]), (2004, [None, *odd[1:]])]
    rows += [(2005, [float("nan"), *odd[1:]]), (2006, [float("inf"), *odd[1:]]), (None, odd), (None, rows[1][1])]
    assert rows_of(centroid_report(vectors(rows), k=9, block=16)) == plain(rows, 9, 5)


def test_ties_go_to_the_smaller_number(vectors):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(2)) for _ in range(4)] + [0.0] * 60) for i in range(200)]
    assert rows_of(centroid_report(vectors(rows), k=6, rounds=3, block=8)) == plain(rows, 6, 3)


def test_fewer_vectors_than_centroids_and_none(vectors):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert rows_of(centroid_report(vectors(rows))) == plain(rows, 40, 5)
    assert centroid_report(vectors([])).collect() == []
    assert centroid_report(vectors([(1, None)])).collect() == []


def test_too_large_a_component_is_an_error(vectors):
    with pytest.raises(Exception, match="too large"):
        centroid_report(vectors([(1, [1e6] * 64)])).collect()


def test_result_at_any_number_of_partitions(vectors, partitions):
    r = np.random.default_rng(5)
    df = vectors([(i, r.normal(size=64).astype(np.float32).tolist()) for i in range(300)])
    found = []
    for n in (1, 7):
        partitions(n)
        found.append(rows_of(centroid_report(df, k=8)))
    assert found[0] == found[1]


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        at = hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_candidates_hold_the_nearest():
    r = np.random.default_rng(6)
    dropped = 0
    for _ in range(200):
        middle = r.integers(-200, 200, 5)
        vectors = middle + r.integers(-30, 30, (20, 5))
        c = r.integers(-200, 200, (12, 5))
        some = candidates(vectors.min(0), vectors.max(0), c)
        assert set(distances(vectors, c).argmin(1).tolist()) <= set(some.tolist())
        dropped += len(c) - len(some)
    assert dropped > 500


def test_distances_are_exact_for_large_numbers():
    v, c = np.array([[(1 << 27) - 1, 3]]), np.array([[-(1 << 27), 4]])
    assert distances(v, c).tolist() == [[((1 << 28) - 1) ** 2 + 1]]


def test_bounds_save_comparisons(vectors):
    """On vectors in groups, blocks keep a few centroids."""
    r = np.random.default_rng(7)
    middle = r.normal(size=(10, 64)) * 2
    df = vectors([(i, (middle[i % 10] + r.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(2000)])
    _, c = centroid_clusters(df, k=10, rounds=2)
    blocks = centroids._blocks(centroids._kept(df, "vec_id", "embedding", 64, 256), c, 32).collect()
    left = [len(candidates(np.array(b.low), np.array(b.high), c)) for b in blocks]
    assert sum(len(b.ids) for b in blocks) == 2000 and np.mean(left) < 5
