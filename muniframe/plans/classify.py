"""Incident classification: preparation, exact stratified split, evaluation, feature reduction."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.aggregates import balance_weights, confusion_metrics
from ..operators.ordering import exact_medians, numbered_as_stored, shuffled_number
from ..session import stored
from .cells import CELL, SETTINGS, CellModel, Cells, count_cells, fit_cells
from .models import SEED, one_hot_stages, population_scaler

LABEL = "label"

# Estimator settings per model name (Spark ML parameter names).
CLASSIFIERS: Mapping[str, Mapping[str, object]] = {
    "regressao_logistica": {"maxIter": 2000},
    "arvore_decisao": {"maxDepth": 30},
    "random_forest": {"numTrees": 150, "maxDepth": 20, "minInstancesPerNode": 5},
    "boosting": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8},
}


def classifier(kind: str, params: Mapping[str, object] | None = None):
    """Weighted estimator. Multi-class boosting is one-vs-rest over binary boosted trees."""
    settings = {**CLASSIFIERS[kind], **(params or {})}
    common = {"featuresCol": "features", "labelCol": LABEL, "weightCol": "weight"}
    if kind == "regressao_logistica":
        return LogisticRegression(family="multinomial", **common, **settings)
    if kind == "arvore_decisao":
        return DecisionTreeClassifier(seed=SEED, **common, **settings)
    if kind == "random_forest":
        return RandomForestClassifier(seed=SEED, **common, **settings)
    if kind == "boosting":
        binary = GBTClassifier(seed=SEED, **{k: v for k, v in common.items() if k != "weightCol"}, **settings)
        return OneVsRest(classifier=binary, **common)
    raise ValueError(f"unknown classifier {kind}")


def label_codes(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """Class names in alphabetical order; the position is the code. A column with over ``most`` classes is refused."""
    names = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{col} has more than {most} classes")
    return names


def encode_label(df: DataFrame, col: str, classes: Sequence[str]) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(col)) - 1
    return df.withColumn(LABEL, code.cast("double"))


def split_position(fractions: Sequence[float], number: Column, size: Column) -> Column:
    """0-based part of row ``number`` of ``size``: cut points are rounded cumulative shares."""
    part, cumulative = F.lit(0), 0.0
    for share in fractions[:-1]:
        cumulative += share
        part = part + (number > F.floor(size * F.lit(cumulative) + 0.5)).cast("int")
    return part


#: Hash ranges per class: only the rows of a range with a cut point in it are ranked.
SPLIT_BITS = 12
#: Ranges of all classes that are sent to every executor, so that rows stay where they are; beyond, rows and ranges meet by a shuffle.
BROADCAST_RANGES = 200_000


def stratified_split(df: DataFrame, label: str, key: str, fractions: Sequence[float] = (0.6, 0.2, 0.2), seed: int = SEED, out: str = "part") -> DataFrame:
    """Exact class shares in every part, reproducible from the row key.

    Rows of a class count as numbered in hash order. Ranges of the hash are counted, and the running
    count gives every row of a range its part, unless a cut point lies inside the range; those few ranges are ranked row by row.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    ranged = hashed.withColumn("__r", F.shiftright("__h", 64 - SPLIT_BITS))
    counts = ranged.groupBy(F.col(label).alias("__label"), F.col("__r").alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__label").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__size": F.sum("__n").over(Window.partitionBy("__label"))})
    first = split_position(fractions, F.col("__before") + 1, F.col("__size"))
    last = split_position(fractions, F.col("__before") + F.col("__n"), F.col("__size"))
    known = stored(counts.withColumn("__part", F.when(first == last, first)).drop("__n"))
    if known.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        known = F.broadcast(known)
    placed = ranged.join(known, ranged[label].eqNullSafe(known["__label"]) & (ranged["__r"] == known["__range"]))
    whole = placed.where(F.col("__part").isNotNull()).withColumn(out, F.col("__part"))
    number = F.row_number().over(Window.partitionBy(label, "__r").orderBy("__h", key)) + F.col("__before")
    cut = placed.where(F.col("__part").isNull()).withColumn(out, split_position(fractions, number, F.col("__size")))
    return whole.unionByName(cut).select(*df.columns, out)


def fit_imputer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> SQLTransformer:
    """Fill numbers with the exact median and strings with the most frequent value of the training rows."""
    fills = {}
    if numeric:
        fills.update({c: f"{median!r}D" for c, median in exact_medians(train, numeric).items()})
    if categorical:
        # Values are counted first; of equal counts the least value fills.
        long = train.select([F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "column", "value").where("value is not null")
        tops = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
        fills.update({r["column"]: "'" + r["mode"].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in tops.collect()})
    replaced = []
    for c in (*numeric, *categorical):
        value = f"CAST(`{c}` AS DOUBLE)" if c in numeric else f"`{c}`"
        replaced.append(f"coalesce({value}, {fills[c]}) AS `{c}`" if c in fills else f"{value} AS `{c}`")
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in (*numeric, *categorical))}), {', '.join(replaced)} FROM __THIS__")


def with_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weights. The weight table has one row per class, and classes are a literal list (see encode_label)."""
    weights = balance_weights(train, label).select(label, "weight")
    return train.join(F.broadcast(weights), label)


class Preparation:
    """Training rows made ready once for any number of fits: imputed and scaled, then as feature vectors, cached as linear estimators pass over them many
    times, or as counts by cell, which trees grow on (see :mod:`.cells`). An ``imputer`` fitted before may cover more columns than ``features``."""

    def __init__(self, train: DataFrame, features: Sequence[str], categorical: Sequence[str], imputer: SQLTransformer | None = None):
        self.features, self.categorical = list(features), [c for c in features if c in categorical]
        self.numeric = [c for c in features if c not in categorical]
        self.train, self.stages = train, [imputer or fit_imputer(train, self.numeric, self.categorical)]
        if self.numeric:
            self.stages.append(population_scaler(self.stages[0].transform(train), self.numeric))
        self._vectors: tuple[PipelineModel, DataFrame] | None = None
        self._cells: tuple[Cells | None] | None = None

    def vectors(self) -> tuple[PipelineModel, DataFrame]:
        """Impute, scale, one-hot and assemble as one model, and the rows (label, weight, features) that it gives."""
        if self._vectors is None:
            inputs = [*[f"{c}__scaled" for c in self.numeric], *[f"{c}__hot" for c in self.categorical]]
            stages = [*self.stages, *one_hot_stages(self.categorical), VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]
            weighted = with_weights(self.train)
            model = Pipeline(stages=stages).fit(weighted)
            self._vectors = model, model.transform(weighted).select(LABEL, "weight", "features").persist()
        return self._vectors

    def cells(self) -> Cells | None:
        """All rows by cell and class; None where there are too many cells to send."""
        if self._cells is None:
            scaled = PipelineModel(self.stages).transform(self.train)
            self._cells = (count_cells(scaled, LABEL, self.numeric, self.categorical),)
        return self._cells[0]

    def counted(self, df: DataFrame) -> DataFrame | None:
        """Other rows by cell and class (n rows each), to evaluate any number of models on them; None where there are no cells."""
        cells = self.cells()
        if cells is None:
            return None
        coded = PipelineModel([*self.stages, cells.binner()]).transform(df)
        return stored(coded.groupBy(LABEL, CELL).agg(F.count(F.lit(1)).alias("n")))

    def evaluate(self, model: PipelineModel, df: DataFrame, counted: DataFrame | None) -> dict[str, float]:
        """Like :func:`evaluate`, from the counts of ``df`` where model and counts are on cells."""
        last = model.stages[-1]
        if counted is None or not isinstance(last, CellModel):
            return evaluate(model, df)
        found = last.transform(counted.select(LABEL, "n", last.recoded(self.cells().places).alias(CELL)))
        return _metrics(found, "n")

    def fit(self, kind: str, params: Mapping[str, object] | None = None, features: Sequence[str] | None = None) -> PipelineModel:
        """The classifier on some of the features (by default all) as one pipeline model."""
        features = list(features or self.features)
        settings = {**CLASSIFIERS[kind], **(params or {})}
        if settings.keys() <= SETTINGS.get(kind, frozenset()) and (cells := self.cells()) is not None:
            cells = cells.of(features)
            return PipelineModel([*self.stages, cells.binner(), fit_cells(self.train.sparkSession, kind, settings, cells)])
        if features != self.features:
            with Preparation(self.train, features, self.categorical, self.stages[0]) as part:
                return part.fit(kind, params)
        model, rows = self.vectors()
        return PipelineModel([*model.stages, classifier(kind, params).fit(rows)])

    def __enter__(self) -> Preparation:
        return self

    def __exit__(self, *_) -> None:
        if self._vectors is not None:
            self._vectors[1].unpersist()


def fit_classifier(
    train: DataFrame, features: Sequence[str], categorical: Sequence[str], kind: str, params: Mapping[str, object] | None = None, imputer: SQLTransformer | None = None
) -> PipelineModel:
    """Impute, one-hot, scale and classify as one pipeline model. An ``imputer`` fitted before may cover more columns than ``features``."""
    with Preparation(train, features, categorical, imputer) as ready:
        return ready.fit(kind, params)


def _metrics(predicted: DataFrame, rows: str | None = None) -> dict[str, float]:
    row = confusion_metrics(predicted, LABEL, "prediction", rows=rows).first()
    return {k: row[k] for k in ("accuracy", "f1_macro", "f1_weighted")}


def evaluate(model: PipelineModel, df: DataFrame) -> dict[str, float]:
    return _metrics(model.transform(df))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, metric: str = "f1_macro", repeats: int = 5, seed: int = SEED
) -> DataFrame:
    """Mean and deviation of the metric loss when one feature is shuffled, over all rows.

    Rows are numbered as they lie. In every repeat a keyed bijection on the numbers gives each row its donor, so nothing is
    sorted; all features and repeats are scored in one pass. ``key`` is not used for the order any more and may be any column.
    A row of a model on cells is the code of its cell, and a shuffled feature is the donor's part of the code.
    """
    coded = isinstance(model.stages[-1], CellModel)
    columns = [CELL] if coded else list(features)
    if coded:
        ready, model = PipelineModel(model.stages[:-1]), model.stages[-1]
        df = ready.transform(df.select(LABEL, *features)).select(LABEL, CELL)
    base = numbered_as_stored(df.select(LABEL, *columns), "__n")
    size = base.agg(F.count(F.lit(1))).scalar()
    donor = shuffled_number(F.col("__n"), F.col("__size"), F.lit(seed), F.col("__repeat"))
    shuffled = base.withColumn("__size", size).withColumn("__repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("__donor", donor).drop("__n", "__size")
    donors = base.select(F.col("__n").alias("__donor"), *[F.col(c).alias(f"__d_{c}") for c in columns])
    paired = shuffled.join(donors, "__donor")
    if coded:
        variants = [F.struct(F.lit(f).alias("feature"), (F.col(CELL) - model.part(f) + model.part(f, f"__d_{CELL}")).alias(CELL)) for f in features]
    else:
        variants = [
            F.struct(F.lit(f).alias("feature"), *[(F.col(f"__d_{g}") if g == f else F.col(g)).alias(g) for g in features]) for f in features
        ]
    scored = model.transform(paired.select("__repeat", LABEL, F.inline(F.array(*variants))))
    permuted = confusion_metrics(scored, LABEL, "prediction", by=["feature", "__repeat"])
    full = confusion_metrics(model.transform(base), LABEL, "prediction").select(metric).scalar()
    loss = permuted.withColumn("loss", full - F.col(metric))
    return loss.groupBy("feature").agg(F.avg("loss").alias("importancia_media"), F.stddev_pop("loss").alias("importancia_desvio"))


@dataclass(frozen=True)
class Trial:
    """One fit of the elimination: what was left out of the features in hand, and whether it stayed out."""

    feature: str | None
    n_features: int
    score: float
    change: float
    dropped: bool


@dataclass(frozen=True)
class Search:
    """The features in hand with their score, the best subset so far, and all trials."""

    features: tuple[str, ...]
    score: float
    best: tuple[str, ...]
    best_score: float
    trials: tuple[Trial, ...]

    def without(self, feature: str, score_of: Callable[[Sequence[str]], float]) -> Search:
        """The state after trying to do without ``feature``. It goes for good unless the score falls; the last one never goes."""
        left = tuple(f for f in self.features if f != feature)
        if not left:
            return self
        score = score_of(left)
        trial = Trial(feature, len(left), score, score - self.score, score >= self.score)
        logged = replace(self, trials=(*self.trials, trial))
        if not trial.dropped:
            return logged
        # Accepted scores never fall, and each has fewer features than the one before: the newest is the best.
        return replace(logged, features=left, score=score, best=left, best_score=score)


@dataclass(frozen=True)
class Elimination:
    search: Search
    importance: DataFrame
    model: PipelineModel


def backward_elimination(
    train: DataFrame, validation: DataFrame, features: Sequence[str], categorical: Sequence[str], kind: str, key: str,
    params: Mapping[str, object] | None = None, metric: str = "f1_macro", repeats: int = 5, save_to: str | None = None,
) -> Elimination:
    """Reduce the features from the least important one on, then fit the best subset, and save that model if a path is given.

    Fill values, scales and counts by cell are found once for all trials; importance is measured once, with all features.
    """
    with Preparation(train, features, categorical) as ready:
        judged = ready.counted(validation) if kind in SETTINGS else None

        def fitted(subset: Sequence[str]) -> tuple[float, PipelineModel]:
            model = ready.fit(kind, params, subset)
            return ready.evaluate(model, validation, judged)[metric], model

        score, model = fitted(features)
        importance = permutation_importance(model, validation, features, key, metric, repeats).persist()
        weakest_first = [r["feature"] for r in importance.orderBy("importancia_media", "feature").collect()]
        start = Search(tuple(features), score, tuple(features), score, (Trial(None, len(features), score, 0.0, False),))
        search = reduce(lambda state, f: state.without(f, lambda subset: fitted(subset)[0]), weakest_first, start)
        final = fitted(search.best)[1]
    if save_to is not None:
        final.write().overwrite().save(save_to)
    return Elimination(search, importance, final)


def compare_models(
    train: DataFrame, validation: DataFrame, test: DataFrame, features: Sequence[str], categorical: Sequence[str], models: Mapping[str, Mapping[str, object]],
    metric: str = "f1_macro",
) -> tuple[DataFrame, dict[str, float]]:
    """Validation metrics per model (best first) and the test metrics of the best one. All models share one preparation, fitted once."""
    with Preparation(train, features, categorical) as ready:
        judged = ready.counted(validation) if SETTINGS.keys() & models.keys() else None
        fitted = {kind: ready.fit(kind, params) for kind, params in models.items()}
        found = [{"modelo": kind, "n_features": len(features), **ready.evaluate(model, validation, judged)} for kind, model in fitted.items()]
    rows = sorted(found, key=lambda r: -r[metric])
    frame = train.sparkSession.createDataFrame(
        [(r["modelo"], r["n_features"], r["accuracy"], r["f1_macro"], r["f1_weighted"]) for r in rows],
        "modelo string, n_features int, accuracy double, f1_macro double, f1_weighted double",
    )
    return frame, evaluate(fitted[rows[0]["modelo"]], test)
