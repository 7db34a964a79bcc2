"""Which features move a prediction: samples, per-row contributions, ranking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.polynomial.legendre import leggauss
from pyspark.ml import Model
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.operators.models import predictor
from chronolode.sources.scratch import scratch_path


def sample_rows(df: DataFrame, size: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded sample of exactly ``min(size, rows)`` rows without replacement.
    Rows are ranked by a hash of seed and key, so the sample does not depend on
    how the table is partitioned."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    drawn = df.withColumn("__h", digest).orderBy("__h", *key).limit(size).drop("__h")
    # a limit ends in one partition; what follows a sample is often costly per row
    return drawn.repartition(max(1, -(-size // 250)), *key)


@dataclass(frozen=True)
class _Leaf:
    """A leaf as a product of interval tests, one per feature on its path.
    ``share`` is the part of the training rows that passes each feature's tests."""

    value: float
    feature: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    share: np.ndarray


def tree_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """Nodes of a fitted tree model, read back from its saved form:
    ``(tree, id, value, cover, left, right, feature, threshold)``."""
    fitted = predictor(model) if hasattr(model, "stages") else model
    path = scratch_path(spark, "model")
    fitted.save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        nodes = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = saved.withColumn("tree", F.lit(0))
    return nodes.select(
        "tree",
        "id",
        F.col("prediction").alias("value"),
        F.col("rawCount").alias("cover"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def _tree_scales(fitted: Model) -> list[float]:
    """What each tree's output counts in the prediction: a forest averages, a
    boosted model adds up weighted trees."""
    weights = list(getattr(fitted, "treeWeights", [1.0]))
    if isinstance(fitted, RandomForestRegressionModel):
        return [w / sum(weights) for w in weights]
    return weights


def _leaves(nodes: Sequence, scales: Sequence[float]) -> tuple[float, list[_Leaf]]:
    """Expected prediction and all leaves of all trees, weighted."""
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    leaves: list[_Leaf] = []
    base = 0.0
    for tree, by_id in sorted(trees.items()):
        scale = scales[tree]
        todo = [(0, {})]
        while todo:
            at, tests = todo.pop()
            node = by_id[at]
            if node["left"] < 0:
                value = scale * node["value"]
                base += value * float(np.prod([t[2] for t in tests.values()]))
                if tests:
                    lo, hi, share = (np.array(x) for x in zip(*tests.values()))
                    leaves.append(_Leaf(value, np.array(list(tests)), lo, hi, share))
                continue
            f, cut = node["feature"], node["threshold"]
            lo, hi, share = tests.get(f, (-np.inf, np.inf, 1.0))
            for child, new_lo, new_hi in ((node["left"], lo, min(hi, cut)), (node["right"], max(lo, cut), hi)):
                part = by_id[child]["cover"] / node["cover"]
                todo.append((child, {**tests, f: (new_lo, new_hi, share * part)}))
    return base, leaves


#: Numbers held at once while a batch is explained.
_HELD = 1 << 21


def _by_length(leaves: Sequence[_Leaf]) -> list[tuple[np.ndarray, ...]]:
    """Leaves of one path length as arrays: value, feature, lo, hi, share."""
    out = []
    for length in sorted({len(leaf.feature) for leaf in leaves}):
        own = [leaf for leaf in leaves if len(leaf.feature) == length]
        parts = [np.stack([getattr(leaf, name) for leaf in own]) for name in ("feature", "lo", "hi", "share")]
        out.append((np.array([leaf.value for leaf in own]), *parts))
    return out


def _contributions(groups: Sequence[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Shapley values of every leaf's game, added up per feature.

    A leaf pays its value times one factor per feature on its path: whether the
    row passes (feature known) or the training share that passes (unknown). The
    weights of coalition sizes are the moments of a uniform ``t`` that lets each
    other feature be known with probability ``t``, so a feature is worth its own
    change of factor times the mean over ``t`` of the product of the others.
    That product is a polynomial; Gauss points of half its degree are exact.
    Leaves with paths of one length share these points and go in blocks."""
    phi = np.zeros_like(x)
    for value, feature, lo, hi, share in groups:
        length = feature.shape[1]
        points, weights = leggauss((length + 1) // 2)
        t = (points + 1) / 2
        block = max(1, _HELD // (len(x) * length * len(t)))
        for at in range(0, len(value), block):
            f, s = feature[at : at + block], share[at : at + block]
            held = x[:, f]
            passed = ((held > lo[at : at + block]) & (held <= hi[at : at + block])).astype(float)
            factors = s[:, :, None] * (1 - t) + passed[..., None] * t
            others = factors.prod(axis=2, keepdims=True) / factors  # no factor is zero for 0 < t < 1
            own = value[at : at + block, None] * (passed - s) * (others @ (weights / 2))
            order = np.argsort(f, axis=None, kind="stable")
            names, first = np.unique(f.ravel()[order], return_index=True)
            phi[:, names] += np.add.reduceat(own.reshape(len(x), -1)[:, order], first, axis=1)
    return phi


def tree_attributions(model: Model, df: DataFrame, features: Sequence[str], row_id: str) -> DataFrame:
    """Additive contributions of each feature to each row's prediction, following
    the training shares along the tree paths: ``(row_id, feature, value, phi,
    base)``, with ``base + sum(phi)`` the prediction. The leaves, whose number the
    training parameters bound, are broadcast; rows stay where they are."""
    fitted = predictor(model) if hasattr(model, "stages") else model
    base, leaves = _leaves(tree_nodes(df.sparkSession, model).collect(), _tree_scales(fitted))
    shared = df.sparkSession.sparkContext.broadcast(_by_length(leaves))
    names = list(features)
    id_type = df.select(row_id).schema[0].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            phi = _contributions(shared.value, x)
            yield pd.DataFrame(
                {
                    row_id: np.repeat(batch[row_id].to_numpy(), len(names)),
                    "feature": np.tile(np.array(names, dtype=object), len(batch)),
                    "value": x.ravel(),
                    "phi": phi.ravel(),
                    "base": base,
                }
            )

    inputs = df.select(row_id, *[F.col(c).cast("double") for c in names])
    return inputs.mapInPandas(explain, f"{row_id} {id_type}, feature string, value double, phi double, base double")


def linear_attributions(
    coefs: Mapping[str, float], df: DataFrame, row_id: str, means: Mapping[str, float] | None = None
) -> DataFrame:
    """Contribution ``b * (x - mean)`` of each feature of a linear model, exact:
    ``(row_id, feature, value, phi)``. Means default to those of ``df``."""
    names = list(coefs)
    if means is None:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
        means = dict(zip(names, row))
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            (F.lit(float(coefs[c])) * (F.col(c) - F.lit(float(means[c])))).alias("phi"),
        )
        for c in names
    ]
    return df.select(row_id, F.inline(F.array(*cells)))


def attribution_ranking(phi: DataFrame) -> DataFrame:
    """Features by mean absolute contribution, largest first."""
    return (
        phi.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        .orderBy(F.desc("mean_abs_phi"), "feature")
    )
