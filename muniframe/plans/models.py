"""Count-forecast models and temporal cross-validation on Spark ML.

Estimators without a Spark counterpart are substitutes: extra-trees is a random
forest without bootstrap on a third of the features per split; Poisson boosting is
gradient boosting on log1p(y), mapped back.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from math import prod

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clip
from ..session import shared_folder, stored
from .metrics import best_per_group, fold_metrics, forecast_metrics, summarize_folds
from .panel import FEATURES, TemporalFolds

SEED = 42
NUMERIC = (*[f"log1p_{c}" for c in FEATURES], "IQV", "log_pop", "tempo")
CYCLIC = ("mes_sin_1", "mes_cos_1", "mes_sin_2", "mes_cos_2")

# Estimator settings per model name (Spark ML parameter names).
DEFAULT_PARAMS: Mapping[str, Mapping[str, object]] = {
    "poisson_glm": {},
    "poisson_regressor": {"regParam": 0.1, "maxIter": 100},
    "tweedie_regressor": {"regParam": 0.1, "maxIter": 100, "variancePower": 1.5},
    "random_forest": {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 5},
    "extra_trees": {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 5},
    "gradient_boosting": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 3},
    "boosted_poisson": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5},
}


def one_hot_stages(cols: Sequence[str]) -> list:
    """Alphabetical codes, one-hot; a value unseen in training is all zeros (the kept slot is the dropped one)."""
    if not cols:
        return []
    codes, hots = [f"{c}__code" for c in cols], [f"{c}__hot" for c in cols]
    indexer = StringIndexer(inputCols=list(cols), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep")
    return [indexer, OneHotEncoder(inputCols=codes, outputCols=hots, dropLast=True)]


def population_scaler(train: DataFrame, cols: Sequence[str]) -> SQLTransformer:
    """Centre and scale by the population standard deviation of the training rows (constant columns are only centred)."""
    stats = train.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = []
    for c in cols:
        mean, std = stats[f"{c}_m"] or 0.0, stats[f"{c}_s"] or 1.0
        scaled.append(f"(CAST(`{c}` AS DOUBLE) - {mean!r}D) / {std!r}D AS `{c}__scaled`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def count_estimator(kind: str, params: Mapping[str, object] | None = None, label: str = "y"):
    settings = {**DEFAULT_PARAMS[kind], **(params or {})}
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "y_hat"}
    if kind in ("poisson_glm", "poisson_regressor"):
        return GeneralizedLinearRegression(family="poisson", link="log", **common, **settings)
    if kind == "tweedie_regressor":
        return GeneralizedLinearRegression(family="tweedie", linkPower=0.0, **common, **settings)
    if kind == "random_forest":
        return RandomForestRegressor(seed=SEED, **common, **settings)
    if kind == "extra_trees":
        return RandomForestRegressor(seed=SEED, bootstrap=False, featureSubsetStrategy="onethird", **common, **settings)
    if kind == "gradient_boosting":
        return GBTRegressor(seed=SEED, **common, **settings)
    if kind == "boosted_poisson":
        return GBTRegressor(seed=SEED, **{**common, "labelCol": "log1p_y"}, **settings)
    raise ValueError(f"unknown model {kind}")


def fit_count_model(
    train: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str], params: Mapping[str, object] | None = None, label: str = "y"
) -> PipelineModel:
    """Preprocessing and estimator as one savable pipeline model; predictions are in ``y_hat``."""
    linear = kind in ("poisson_regressor", "tweedie_regressor")
    stages = [population_scaler(train, numeric)] if linear else []
    names = [f"{c}__scaled" for c in numeric] if linear else list(numeric)
    stages += one_hot_stages(categorical)
    stages.append(VectorAssembler(inputCols=[*names, *[f"{c}__hot" for c in categorical]], outputCol="features", handleInvalid="skip"))
    if kind == "boosted_poisson":
        stages.insert(0, SQLTransformer(statement=f"SELECT *, log1p(CAST(`{label}` AS DOUBLE)) AS log1p_y FROM __THIS__"))
    stages.append(count_estimator(kind, params, label))
    if kind == "boosted_poisson":
        stages.append(SQLTransformer(statement="SELECT * EXCEPT (y_hat), expm1(y_hat) AS y_hat FROM __THIS__"))
    return Pipeline(stages=stages).fit(train)


def predict_counts(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus a non-negative ``y_pred``."""
    return model.transform(df).select(*keep, clip(F.col("y_hat"), lo=0.0).alias("y_pred"))


def _compact(features: DataFrame) -> DataFrame:
    """The same rows, cached, in partitions cut by size. Every step of a solver is a job with a task per partition, so a small
    panel must not keep the partition count of the shuffles that made it from large tables."""
    return stored(features).persist()


def _month_sizes(df: DataFrame, label: str) -> list:
    """Rows and total per month: one driver row per calendar month."""
    return df.groupBy("data").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("total")).collect()


def cv_models(
    features: DataFrame,
    folds: TemporalFolds,
    models: Mapping[str, tuple[str, Mapping[str, object]]],
    numeric: Sequence[str],
    categorical: Sequence[str],
    by: Mapping[str, Sequence[object]] | None = None,
    keep: Sequence[str] = ("unit", "categoria", "data", "y"),
    label: str = "y",
    parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold predictions of every model on every fold (optionally one fit per ``by`` value).

    ``models`` maps a name to (kind, parameters). Features are stored and cached once, in as many partitions as their
    size asks for (see :func:`_compact`); fits are Spark jobs started from a few driver threads. Each fold's predictions go to a
    folder below the shared checkpoint directory, so neither the driver nor the
    final plan grows with folds times models.
    """
    features = _compact(features)
    root = shared_folder(features.sparkSession, "cv")
    groups: list[tuple[str | None, object]] = [(None, None)]
    if by:
        (column, values), = by.items()
        groups = [(column, v) for v in values]

    tasks = []
    for column, value in groups:
        data = features if column is None else features.where(F.col(column) == value)
        sizes = _month_sizes(data, label)
        for fold in range(1, folds.count + 1):
            lo, hi = folds.start_of(fold), folds.end_of(fold)
            trained = sum(r["total"] or 0 for r in sizes if r["data"] < lo)
            validated = sum(r["n"] for r in sizes if lo <= r["data"] < hi)
            if trained and validated:
                tasks += [(data, column, value, fold, name, *spec) for name, spec in models.items()]

    def run(task) -> str:
        data, column, value, fold, name, kind, params = task
        # A model fitted for one category sees that column as a constant.
        cats = [c for c in categorical if not (by and c in by)]
        model = fit_count_model(folds.train(data, fold), kind, numeric, cats, params, label)
        path = f"{root}/modelo={name}/grupo={groups.index((column, value))}/fold={fold}"
        predict_counts(model, folds.validation(data, fold), keep).write.mode("overwrite").parquet(path)
        return path

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            paths = list(pool.map(run, tasks))
    finally:
        features.unpersist()
    if not paths:
        raise ValueError("no fold has both training and validation rows")
    return features.sparkSession.read.option("basePath", root).parquet(root).drop("grupo")


def cv_results(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per model and fold, then fold means: sorted input for model choice."""
    per_fold = forecast_metrics(predictions, "y", "y_pred", ["modelo", "fold", *by])
    return summarize_folds(per_fold, [*by, "modelo"])


def best_models(summary: DataFrame, group: Sequence[str] = ("categoria",)) -> DataFrame:
    return best_per_group(summary, group, "WAPE", "modelo")


def winning_predictions(predictions: DataFrame, best: DataFrame, on: Sequence[str] = ("categoria", "modelo")) -> DataFrame:
    """Predictions of the winning model of each group."""
    return predictions.join(best.select(*on), list(on), "left_semi")


def baseline_summary(panel: DataFrame, folds: TemporalFolds, baselines: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return summarize_folds(fold_metrics(panel, folds, "y", baselines, by), [*by, "modelo"])


def refit_winners(
    features: DataFrame, winners: Mapping[object, tuple[str, Mapping[str, object]]], column: str, numeric: Sequence[str], categorical: Sequence[str], label: str = "y"
) -> dict[object, PipelineModel]:
    """One model per group on its full history. The features are kept while the solvers iterate over them."""
    cats = [c for c in categorical if c != column]
    features = _compact(features)
    try:
        return {
            value: fit_count_model(features.where(F.col(column) == value), kind, numeric, cats, params, label)
            for value, (kind, params) in winners.items()
        }
    finally:
        features.unpersist()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Search grid, in Spark ML names. Column sampling is featureSubsetStrategy (a share of the features), the least
# gain of a split is minInfoGain; penalties on leaf weights have no Spark counterpart.
SEARCH_GRID: Mapping[str, Sequence[object]] = {
    "maxIter": (300, 500, 800),
    "stepSize": (0.01, 0.02, 0.03, 0.05),
    "maxDepth": (2, 3, 4, 5),
    "minInstancesPerNode": (1, 5, 10, 20),
    "subsamplingRate": (0.7, 0.8, 0.9, 1.0),
    "featureSubsetStrategy": ("0.7", "0.8", "0.9", "all"),
    "minInfoGain": (0.0, 0.1, 0.5, 1.0),
}


def sample_grid(grid: Mapping[str, Sequence[object]], n_iter: int = 20, seed: int = SEED) -> list[dict[str, object]]:
    """``n_iter`` distinct grid points, without replacement."""
    names = sorted(grid)
    size = prod(len(grid[n]) for n in names)
    chosen = random.Random(seed).sample(range(size), min(n_iter, size))
    points = list(product(*[grid[n] for n in names]))
    return [dict(zip(names, points[i])) for i in chosen]


def random_search(
    features: DataFrame, folds: TemporalFolds, grid: Mapping[str, Sequence[object]], numeric: Sequence[str], categorical: Sequence[str],
    by: Mapping[str, Sequence[object]] | None = None, kind: str = "boosted_poisson", n_iter: int = 20, seed: int = SEED, parallelism: int = 4,
) -> tuple[DataFrame, dict[str, dict[str, object]]]:
    """(summary per group and trial, parameters per trial). All trials share the folds."""
    trials = {f"trial_{i:03d}": p for i, p in enumerate(sample_grid(grid, n_iter, seed), 1)}
    predictions = cv_models(features, folds, {n: (kind, p) for n, p in trials.items()}, numeric, categorical, by, parallelism=parallelism)
    return cv_results(predictions, list(by or ())), trials


def overall_comparison(named: Mapping[str, DataFrame]) -> DataFrame:
    """Pooled metrics of several prediction sets, one row each."""
    frames = [df.select("y", "y_pred", F.lit(name).alias("modelo")) for name, df in named.items()]
    together = frames[0]
    for f in frames[1:]:
        together = together.unionByName(f)
    return forecast_metrics(together, "y", "y_pred", ["modelo"])
