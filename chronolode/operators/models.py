"""The four regressors, as descriptions that are fitted by ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.operators.ordering import TimeOrder, with_position
from chronolode.sources.scratch import checkpointed, fixed_partitions, materialise

DEEPEST_TREE = 30
MAX_BINS = 256


@dataclass(frozen=True)
class ModelSpec:
    """A regressor by name, family and parameters."""

    name: str
    family: str
    params: Mapping[str, Any] = field(default_factory=dict, hash=False)
    seed: int = 42

    def with_params(self, **params: Any) -> ModelSpec:
        return replace(self, params={**self.params, **params})


def ridge(alpha: float = 1.0, name: str = "ridge") -> ModelSpec:
    return ModelSpec(name, "ridge", {"alpha": alpha})


def tree(max_depth: int | None = 10, min_leaf: int = 1, name: str = "tree", seed: int = 42) -> ModelSpec:
    """``max_depth=None`` grows to the deepest tree Spark accepts."""
    return ModelSpec(name, "tree", {"max_depth": max_depth, "min_leaf": min_leaf}, seed)


def forest(
    trees: int = 200,
    max_depth: int | None = 12,
    min_leaf: int = 1,
    features: float | str = "all",
    bootstrap: bool = True,
    name: str = "forest",
    seed: int = 42,
) -> ModelSpec:
    params = {"trees": trees, "max_depth": max_depth, "min_leaf": min_leaf, "features": features, "bootstrap": bootstrap}
    return ModelSpec(name, "forest", params, seed)


def boosted(
    rounds: int = 400,
    rate: float = 0.05,
    max_depth: int = 6,
    min_leaf: int = 1,
    rows: float = 0.8,
    cols: float = 0.8,
    name: str = "boosted",
    seed: int = 42,
) -> ModelSpec:
    """Boosted trees. ``rate`` is the share of the residual that each round
    corrects. Spark fits its rounds to twice the residual, so its step is half
    of ``rate``; its first tree always counts in full. Columns are drawn per
    node, not per tree."""
    params = {"rounds": rounds, "rate": rate, "max_depth": max_depth, "min_leaf": min_leaf, "rows": rows, "cols": cols}
    return ModelSpec(name, "boosted", params, seed)


def default_models(scale: float = 1.0) -> list[ModelSpec]:
    """The benchmark's four models; ``scale`` shrinks the tree counts only."""
    return [
        ridge(),
        tree(),
        forest(trees=max(2, int(200 * scale))),
        boosted(rounds=max(2, int(400 * scale))),
    ]


@dataclass(frozen=True)
class TrainingTable:
    """A checkpointed table of ``pos``, the features and the label. Its
    partitions are fixed and hold positions evenly, so fits on any leading part
    are balanced, need no shuffle of their own, and give the same trees for the
    same seed. ``vectors`` holds the same rows as ``pos``, the features in one vector
    and the label, where many fits read them (``assembled``)."""

    df: DataFrame
    rows: int
    features: tuple[str, ...]
    label: str = "label"
    pos: str = "pos"
    vectors: DataFrame | None = None

    def first(self, rows: int) -> TrainingTable:
        """The part before position ``rows``."""
        before = F.col(self.pos) < rows
        vectors = None if self.vectors is None else self.vectors.where(before)
        return replace(self, df=self.df.where(before), rows=rows, vectors=vectors)

    def between(self, start: int, stop: int) -> DataFrame:
        return self._range(self.df, start, stop)

    def score(self, model: PipelineModel, start: int, stop: int) -> DataFrame:
        """``prediction`` of a range beside ``pos`` and the label, with no other column promised."""
        if self.vectors is None:
            return score(model, self.between(start, stop))
        return model.stages[-1].transform(self._range(self.vectors, start, stop)).drop("__features")

    def _range(self, df: DataFrame, start: int, stop: int) -> DataFrame:
        return df.where((F.col(self.pos) >= start) & (F.col(self.pos) < stop))


def assembled(table: TrainingTable) -> TrainingTable:
    """The table with its features written as vectors too, in the same partitions and order.
    A fit reads its rows several times; so its vectors are put together once for all fits."""
    if table.vectors is not None:
        return table
    whole = _assembler(table).transform(table.df.select(table.pos, *table.features, table.label))
    return replace(table, vectors=checkpointed(whole.select(table.pos, "__features", table.label)))


def _assembler(table: TrainingTable) -> VectorAssembler:
    return VectorAssembler(inputCols=list(table.features), outputCol="__features")


def lay_out(placed: DataFrame, rows: int, features: Sequence[str], label: str = "label") -> TrainingTable:
    """Fix a positioned feature table for fitting. The number of partitions
    follows from the row count alone: they hold 25,000 rows, in very long tables up
    to a million."""
    per_part = max(25_000, min(1_000_000, -(-rows // 10_000)))
    kept = placed.select("pos", *features, label)
    return TrainingTable(fixed_partitions(kept, max(1, -(-rows // per_part)), "pos"), rows, tuple(features), label)


def training_table(
    df: DataFrame, order: TimeOrder, features: Sequence[str], label: str = "label"
) -> TrainingTable:
    """Put all series of a feature table in one time order. The features are
    written first, since counting, sorting and numbering each read them."""
    timeline = TimeOrder(order.ts, ties=(*order.ties, *order.keys))
    written = materialise(df.select(*order.all_cols, *features, label), "features")
    return lay_out(with_position(written, timeline), written.count(), features, label)


def _share(features: float | str) -> str:
    return features if isinstance(features, str) else repr(float(features))


def _depth(max_depth: int | None) -> int:
    return DEEPEST_TREE if max_depth is None else int(max_depth)


def estimator(spec: ModelSpec, label: str):
    """The ``pyspark.ml`` tree estimator of a spec."""
    p = spec.params
    common = {
        "labelCol": label,
        "featuresCol": "__features",
        "maxBins": MAX_BINS,
        "maxDepth": _depth(p["max_depth"]),
        "minInstancesPerNode": int(p["min_leaf"]),
        "seed": spec.seed,
    }
    match spec.family:
        case "tree":
            return DecisionTreeRegressor(**common)
        case "forest":
            return RandomForestRegressor(
                numTrees=int(p["trees"]),
                featureSubsetStrategy=_share(p["features"]),
                bootstrap=p["bootstrap"],
                subsamplingRate=1.0,
                **common,
            )
        case "boosted":
            return GBTRegressor(
                maxIter=int(p["rounds"]),
                stepSize=float(p["rate"]) / 2,
                subsamplingRate=float(p["rows"]),
                featureSubsetStrategy="all" if p["cols"] == 1 else _share(p["cols"]),
                **common,
            )
    raise ValueError(f"unknown model family {spec.family!r}")


def _ridge_estimator(train: DataFrame, spec: ModelSpec, label: str) -> LinearRegression:
    """Ridge on raw features with a free intercept. Spark divides the penalty by
    the label's deviation and the loss by the row count; both are undone here."""
    stats = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(
        labelCol=label,
        featuresCol="__features",
        solver="normal",
        elasticNetParam=0.0,
        standardization=False,
        regParam=float(spec.params["alpha"]) * (stats["sd"] or 0.0) / stats["n"],
    )


def fit(spec: ModelSpec, table: TrainingTable) -> Model:
    """Fit on all rows of ``table``. The result adds ``prediction``."""
    assembler = _assembler(table)
    train = table.df.select(table.pos, *table.features, table.label)
    stage = _ridge_estimator(train, spec, table.label) if spec.family == "ridge" else estimator(spec, table.label)
    if table.vectors is None:
        return Pipeline(stages=[assembler, stage]).fit(train)
    return PipelineModel(stages=[assembler, stage.fit(table.vectors)])


def score(model: Transformer, df: DataFrame) -> DataFrame:
    """Add ``prediction``; works on a stream as well."""
    return model.transform(df).drop("__features")


def predictor(model: Model):
    """The fitted regressor inside a model returned by ``fit``."""
    return model.stages[-1]
