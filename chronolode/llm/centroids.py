"""Centroid clustering: vectors along a Hilbert curve in blocks with min/max boxes;
box distances leave each block a few candidate centroids, and those are compared
exactly.

1. Vectors become whole numbers and are written once. The first centroids are the
   ``k`` vectors of the smallest hash.
2. The Hilbert curve runs through the main axes of the first centroids (``AXES``
   of them, ``BITS`` bits each; its course decides how much work the bounds save and
   never a result). Vectors are dealt out by ranges of the curve, a hash as the last
   key, so that one vector may hold any share of the rows, and cut into blocks of
   ``BLOCK`` with the smallest and largest value of every component: the zone map.
   Blocks are written once and read in every round.
3. For a block, one centroid near the middle of its box is the pivot. How much
   nearer than the pivot another centroid can be to a place in the box is a sum over
   components, each largest at an edge of the box; a centroid that is never nearer
   (nor as near with a smaller number) is no candidate. The rest is compared with
   every vector in whole numbers, exact at any order of summation.
4. A task adds up its vectors by centroid, so ``k`` rows a task are shuffled and ``k``
   sums reach the driver in a round.

Defined results: vectors that are null, of another length, or with a component
that is null, NaN or infinite are left out; components of 2^19 or more in size are an
error, as squared distances would not fit 64 bits; repeated rows count as often as
they occur; a null id sorts last among the first centroids, equal hashes by the
vector; with fewer than ``k`` vectors each is a centroid; an empty table gives an
empty one; other columns are ignored whatever their names. There are no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.common import materialise, small_batches, table

K, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, "2"
#: Vectors in a block, and blocks handed to a Python worker at a time.
BLOCK, BLOCKS_AT_ONCE = 128, 64
#: Axes of the curve and bits of a place on each.
AXES, BITS = 8, 4
#: Components from this size on are an error.
TOO_LARGE = 1 << 19


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The number of each row's cell along the Hilbert curve; places: whole numbers
    below 2^bits, a column per axis, all bits together at most 63."""
    x = places.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            up = (axis >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ axis) & low)
            if axis is not x[0]:
                axis ^= swap
            x[0] ^= np.where(up, low, swap)
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | (axis >> level) & 1
    return out


def _whole(vec: Column, scale: int) -> Column:
    def one(x: Column) -> Column:
        large = F.abs(x) >= TOO_LARGE
        return F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(
            F.floor(F.lit(scale) * x.cast("double")).cast("int")
        )

    return F.transform(vec, one)


def _kept(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that count, as whole numbers."""
    vec = df[vec_col]
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter((F.size(vec) == dim) & finite)
    return rows.select(df[id_col].alias("id"), _whole(vec, scale).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _along_curve(middle: np.ndarray, axes: np.ndarray, spread: np.ndarray, dim: int):
    """Adds the place of each vector on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column("v"), dim) - middle) @ axes / spread
            cells = np.clip(np.floor((at + 3) / 6 * (1 << BITS)), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hilbert(cells.astype(np.int64), BITS))], [*batch.schema.names, "place"]
            )

    return run


def _cut(block: int, dim: int):
    """Neighbours on the curve as one row: ids, vectors, and the box around them."""

    def rows(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        starts = np.arange(0, len(ids), block)
        ends = np.append(starts[1:], len(ids))
        offsets = np.append(starts, len(ids)).astype(np.int32)
        low, high = np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts)
        edges = np.arange(len(starts) + 1, dtype=np.int32) * dim
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(offsets), ids),
                pa.array([vectors[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                *(pa.ListArray.from_arrays(pa.array(edges), pa.array(side.ravel())) for side in (low, high)),
            ],
            ["ids", "vectors", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids.append(batch.column("id"))
            vectors.append(_matrix(batch.column("v"), dim))
            if sum(map(len, ids)) >= 8 * block:
                held, all_vectors = pa.concat_arrays(ids), np.concatenate(vectors)
                n = len(held) // block * block
                yield rows(held[:n], all_vectors[:n])
                ids, vectors = [held[n:]], [all_vectors[n:]]
        if sum(map(len, ids)):
            yield rows(pa.concat_arrays(ids), np.concatenate(vectors))

    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that can be the nearest of a place in the
    box."""
    pivot = int(((2 * centroids - (low + high)) ** 2).sum(1).argmin())
    c, p = centroids, centroids[pivot]
    # (x - c)^2 - (x - p)^2 falls with x where c > p: its least value is at an edge
    edge = np.where(c > p, high, low)
    least = (c * c - p * p - 2 * edge * (c - p)).sum(1)
    may = (least < 0) | ((least == 0) & (np.arange(len(c)) <= pivot))
    return np.flatnonzero(may)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances. Products of doubles are exact while sums of them stay
    below 2^53; beyond that, whole numbers are used."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * vectors.shape[1] * largest**2 < 1 << 53 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)


def _nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block: ids, vectors, their centroids and distances."""
    dim = centroids.shape[1]
    low, high = (_matrix(batch.column(side), dim).astype(np.int64) for side in ("low", "high"))
    for i in range(batch.num_rows):
        vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)
        some = candidates(low[i], high[i], centroids)
        far = distances(vectors, centroids[some])
        best = far.argmin(1)
        yield batch.column("ids")[i].values, vectors, some[best], far[np.arange(len(best)), best]


def _summed(centroids: np.ndarray):
    """Sums and counts by centroid over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, vectors, which, _ in _nearest(batch, centroids):
                np.add.at(sums, which, vectors)
                count += np.bincount(which, minlength=len(count))
        edges = np.arange(len(count) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), pa.ListArray.from_arrays(pa.array(edges), pa.array(sums.ravel()))],
            ["c", "n", "s"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, which, far in _nearest(batch, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return run


def _blocks(kept: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """The zone map: one row per block of neighbours on the curve."""
    dim, id_type = centroids.shape[1], dict(kept.dtypes)["id"]
    middle = centroids.mean(0)
    axes = np.linalg.svd(centroids - middle, full_matrices=False)[2][:AXES].T
    spread = np.maximum(((centroids - middle) @ axes).std(0), 1.0)
    placed = kept.mapInArrow(_along_curve(middle, axes, spread, dim), f"id {id_type}, v array<int>, place long")
    # the written rows are read in the same order each time, so the last key stays the same
    salted = placed.withColumn("salt", F.xxhash64("id", F.monotonically_increasing_id()))
    sorted_rows = salted.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("id", "v")
    cut = sorted_rows.mapInArrow(_cut(block, dim), f"ids array<{id_type}>, vectors binary, low array<int>, high array<int>")
    return materialise(cut, "blocks")


def centroid_clusters(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    salt: str = SALT,
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that counts, written, and the final
    centroids."""
    spark = df.sparkSession
    kept = materialise(_kept(df, id_col, vec_col, dim, scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = kept.select("v", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        none = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none, centroids
    blocks = _blocks(kept, centroids, block)
    with small_batches(spark, BLOCKS_AT_ONCE):
        for _ in range(rounds):
            parts = blocks.mapInArrow(_summed(centroids), "c int, n long, s array<long>").filter("n > 0")
            total = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"))
            centroids = centroids.copy()
            for r in total.collect():
                centroids[r.c] = [x // r.n for x in r.s]
    id_type = dict(kept.dtypes)["id"]
    return (
        materialise(blocks.mapInArrow(_assigned(centroids), f"id {id_type}, cluster int, distance long"), "assigned", BLOCKS_AT_ONCE),
        centroids,
    )


def centroid_report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings: int | str) -> DataFrame:
    """One row per vector: its cluster and distance, the distances summed over the
    cluster and over all, and the digest of the centroid."""
    spark = df.sparkSession
    assigned, centroids = centroid_clusters(df, id_col, vec_col, **settings)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_report(table(spark, folder, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The rounds one after the other."""
    out = f"""
with v as materialized (
  select vec_id, row_number() over () as rid, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as p
  from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
c0 as materialized (
  select row_number() over (order by sha256('{SALT}:' || vec_id) nulls last, p) - 1 as c, p
  from v qualify c < {k}),"""
    for i in range(rounds + 1):
        out += f"""
a{i} as materialized (
  select rid, arg_min(c, d * {k} + c) as c, min(d) as d from (
    select rid, c, list_sum([(v.p[i] - w.p[i]) * (v.p[i] - w.p[i]) for i in range(1, {DIM + 1})])::bigint as d from v, c{i} as w)
  group by rid),"""
        if i < rounds:
            out += f"""
s{i} as (
  select c, i, cast(floor(sum(x) / count(*)) as bigint) as x
  from (select c, unnest(p) as x, unnest(range({DIM})) as i from v join a{i} using (rid)) group by c, i),
c{i + 1} as materialized (
  select o.c, coalesce(n.p, o.p) as p
  from c{i} as o left join (select c, list(x order by i) as p from s{i} group by c) as n using (c)),"""
    return f"""{out[:-1]}
select v.vec_id, cast(a.c as int) as cluster, a.d as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(w.p, ',')) as centroid_sha256
from v join a{rounds} as a using (rid) join c{rounds} as w on w.c = a.c
"""


SQL = _sql()
