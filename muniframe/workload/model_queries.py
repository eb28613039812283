"""Forecast and classification models on the driver tables.

What a model predicts has no SQL form; what it was given and asked for has. Every query returns the rows and totals that
its predictions cover, by model, fold and group, counted from the predictions, and booleans that hold if the model is sound
(no missing or negative forecast, metrics in their range, the choice the best of all). SQL states the same from the tables. Data are whole;
the folds are years, and estimator sizes are smaller than the defaults in ``plans.models`` and ``plans.classify`` unless a query says full size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import gain_table
from ..plans.classify import (
    CLASSIFIERS, backward_elimination, compare_models, encode_label, evaluate, fit_classifier, label_codes, permutation_importance, stratified_split,
)
from ..plans.metrics import forecast_metrics
from ..plans.models import (
    CYCLIC, NUMERIC, baseline_summary, best_models, cv_models, cv_results, predict_counts, random_search, refit_winners, winning_predictions,
)
from ..plans.panel import BASELINES, naive_baselines
from ..session import stored
from .adapters import CATEGORIES, HISTORY_SQL, YEAR_FOLDS, baselines, features
from .catalog import Tables, query

GLOBAL_CATEGORICAL = ("unit_name", "categoria")
SMALL = {
    "random_forest": {"numTrees": 20, "maxDepth": 6}, "extra_trees": {"numTrees": 20, "maxDepth": 6},
    "gradient_boosting": {"maxIter": 10}, "boosted_poisson": {"maxIter": 10, "maxDepth": 4}, "poisson_glm": {"maxIter": 25},
    "poisson_regressor": {"maxIter": 25}, "tweedie_regressor": {"maxIter": 25},
}


def _frame(t: Tables) -> DataFrame:
    return features(t).withColumn("unit_name", F.col("unit").cast("string"))


def _cv(t: Tables, kinds: list[str], by: bool = False, sizes: Mapping[str, Mapping[str, object]] = SMALL, parallelism: int = 4) -> DataFrame:
    specs = {k: (k, sizes.get(k, {})) for k in kinds}
    numeric = [*NUMERIC, *CYCLIC] if by else [*NUMERIC, "mes"]
    return cv_models(_frame(t), YEAR_FOLDS, specs, numeric, GLOBAL_CATEGORICAL, {"categoria": CATEGORIES} if by else None, parallelism=parallelism)


#: The rows that the folds validate: full history, by year of fold.
ASKED_SQL = HISTORY_SQL + """,
asked AS (SELECT *, CASE WHEN data < DATE '2001-01-01' THEN 1 ELSE 2 END AS fold FROM hist WHERE lag_12 IS NOT NULL AND data >= DATE '2000-01-01')"""


def _facts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Rows and totals of predictions by model and fold, and whether all forecasts are usable."""
    sound = F.coalesce(F.col("y_pred") >= 0, F.lit(False))
    rows = predictions.groupBy("modelo", F.col("fold").cast("bigint").alias("fold"), *by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("total_real"), F.every(sound).alias("sound"))


def _facts_sql(models: list[str], by: str = "") -> str:
    names = ", ".join(f"('{m}')" for m in models)
    extra = f", {by}" if by else ""
    return f"""WITH {ASKED_SQL}
SELECT m.modelo, CAST(fold AS BIGINT) AS fold{extra}, count(*) AS n, CAST(sum(y) AS DOUBLE) AS total_real, TRUE AS sound
FROM asked CROSS JOIN (VALUES {names}) AS m(modelo) GROUP BY m.modelo, fold{extra}"""


@query(_facts_sql(["poisson_glm"], "categoria"))
def poisson_glm_cv(t: Tables) -> DataFrame:
    return _facts(_cv(t, ["poisson_glm"]), ["categoria"])


@query(_facts_sql(["poisson_regressor", "tweedie_regressor"]), "tweedie_glm")
def linear_count_models_cv(t: Tables) -> DataFrame:
    """Regularised Poisson and Tweedie, pooled over categories."""
    return _facts(_cv(t, ["poisson_regressor", "tweedie_regressor"]), [])


@query(_facts_sql(["random_forest", "extra_trees"]), "rf_cv")
def forest_models_cv(t: Tables) -> DataFrame:
    return _facts(_cv(t, ["random_forest", "extra_trees"]), [])


@query(_facts_sql(["gradient_boosting", "boosted_poisson"]), "gbt_cv")
def boosted_models_cv(t: Tables) -> DataFrame:
    return _facts(_cv(t, ["gradient_boosting", "boosted_poisson"]), [])


_PER_CATEGORY_SQL = f"""WITH {ASKED_SQL}
SELECT categoria, count(*) AS n, CAST(sum(y) AS DOUBLE) AS total_real, {{extra}} FROM asked GROUP BY categoria"""


@query(_PER_CATEGORY_SQL.format(extra="TRUE AS is_best, TRUE AS gain_adds_up"))
def model_choice_per_category(t: Tables) -> DataFrame:
    """One fit in full size per category and fold, the best model per category, its gain over the best naive forecast."""
    predictions = _cv(t, ["poisson_regressor", "random_forest", "gradient_boosting"], by=True, sizes={}, parallelism=8).persist()
    summary = cv_results(predictions, ["categoria"])
    best = best_models(summary)
    naive = best_models(baseline_summary(baselines(t), YEAR_FOLDS, list(BASELINES), ["categoria"]))
    gains = gain_table(best, naive, ["categoria"], ("_modelo", "_baseline"), ["WAPE", "MAE"])
    least = summary.groupBy("categoria").agg(F.min("WAPE").alias("least"))
    covered = winning_predictions(predictions, best).groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("total_real"))
    adds_up = F.abs(F.col("WAPE_modelo") + F.col("gain_WAPE_abs") - F.col("WAPE_baseline")) < 1e-9
    return covered.join(gains, "categoria").join(least, "categoria").select("categoria", "n", "total_real", (F.col("WAPE_modelo") == F.col("least")).alias("is_best"), adds_up.alias("gain_adds_up"))


@query(f"""WITH {ASKED_SQL}
SELECT m.modelo, count(*) AS n, CAST(sum(y) AS DOUBLE) AS "TOTAL_REAL", TRUE AS measured
FROM asked CROSS JOIN (VALUES ('cross_validated'), ('refit'), ('naive')) AS m(modelo) GROUP BY m.modelo""")
def refit_and_compare(t: Tables) -> DataFrame:
    """Out-of-fold predictions of each category's winner, its refit on full history, and the naive forecast, over the same rows.
    The refit has seen them, so its row shows the fit and not a forecast."""
    frame = stored(_frame(t))
    kinds = ["poisson_regressor", "gradient_boosting"]
    predictions = cv_models(frame, YEAR_FOLDS, {k: (k, SMALL[k]) for k in kinds}, [*NUMERIC, *CYCLIC], GLOBAL_CATEGORICAL, {"categoria": CATEGORIES}).persist()
    best = best_models(cv_results(predictions, ["categoria"]))
    winners = {r["categoria"]: (r["modelo"], SMALL[r["modelo"]]) for r in best.collect()}  # one row per category
    models = refit_winners(frame, winners, "categoria", [*NUMERIC, *CYCLIC], GLOBAL_CATEGORICAL)
    keys = ["unit", "categoria", "data"]
    chosen = winning_predictions(predictions, best)
    asked = frame.join(chosen.select(*keys), keys, "left_semi")
    parts = {"cross_validated": chosen.select("y", "y_pred"), "naive": naive_baselines(asked).select("y", F.col("baseline_media_6m").alias("y_pred"))}
    for value, model in models.items():
        part = predict_counts(model, asked.where(F.col("categoria") == value), ["y"])
        parts["refit"] = parts["refit"].unionByName(part) if "refit" in parts else part
    together = None
    for name, df in parts.items():
        named = df.select(F.lit(name).alias("modelo"), "y", "y_pred")
        together = named if together is None else together.unionByName(named)
    counts = together.groupBy("modelo").agg(F.count(F.lit(1)).alias("n"))
    metrics = forecast_metrics(together, "y", "y_pred", ["modelo"])
    return metrics.join(counts, "modelo").select("modelo", "n", F.col("TOTAL_REAL").cast("double").alias("TOTAL_REAL"), F.coalesce(F.col("WAPE") >= 0, F.lit(False)).alias("measured"))


@query("SELECT categoria, CAST(4 AS BIGINT) AS trials, TRUE AS best_is_least FROM (SELECT DISTINCT o_orderpriority AS categoria FROM orders)", "random_search")
def random_search_per_category(t: Tables) -> DataFrame:
    """Four drawn settings, every category; the best one has the least error of all trials."""
    grid = {"maxIter": (5, 10), "stepSize": (0.05, 0.1), "maxDepth": (2, 3), "featureSubsetStrategy": ("all", "onethird"), "minInfoGain": (0.0, 0.01)}
    summary, _ = random_search(_frame(t), YEAR_FOLDS, grid, [*NUMERIC, *CYCLIC], GLOBAL_CATEGORICAL, {"categoria": CATEGORIES}, n_iter=4)
    summary = summary.persist()
    every = summary.groupBy("categoria").agg(F.count_distinct("modelo").alias("trials"), F.min("WAPE").alias("least"))
    best = best_models(summary).select("categoria", "WAPE")
    return every.join(best, "categoria").select("categoria", "trials", (F.col("WAPE") == F.col("least")).alias("best_is_least"))


CLASS_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASS_FEATURES = [*CLASS_NUMERIC, "l_linestatus"]
CLASS_CATEGORICAL = ["l_linestatus"]


def _parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = t.lineitem.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("row_id"), *CLASS_FEATURES, "l_returnflag"
    )
    coded = encode_label(rows, "l_returnflag", label_codes(rows, "l_returnflag")).drop("l_returnflag")
    split = stored(stratified_split(coded, "label", "row_id"))
    return tuple(split.where(F.col("part") == i).drop("part") for i in range(3))


_SUPPORT_SQL = """SELECT l_returnflag AS label, CAST(floor(count(*) * 0.8 + 0.5) - floor(count(*) * 0.6 + 0.5) AS BIGINT) AS support FROM lineitem GROUP BY l_returnflag"""


def _evaluated(t: Tables, kind: str, params: dict) -> DataFrame:
    """Validation rows of each class that the model gave a class to."""
    names = label_codes(t.lineitem, "l_returnflag")
    train, validation, _ = _parts(t)
    model = fit_classifier(train, CLASS_FEATURES, CLASS_CATEGORICAL, kind, params)
    found = model.transform(validation).where(F.col("prediction").isin(*map(float, range(len(names))))).persist()
    right = evaluate(model, validation)
    sound = all(0 <= right[k] <= 1 for k in ("accuracy", "f1_macro", "f1_weighted"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("label") + 1).cast("int"))
    return found.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("support")).withColumn("measured", F.lit(sound))


_EVAL_SQL = f"SELECT *, TRUE AS measured FROM ({_SUPPORT_SQL})"


@query(_EVAL_SQL, "logreg_eval")
def logistic_eval(t: Tables) -> DataFrame:
    return _evaluated(t, "regressao_logistica", {"maxIter": 50})


@query(_EVAL_SQL)
def tree_eval(t: Tables) -> DataFrame:
    return _evaluated(t, "arvore_decisao", {"maxDepth": 8})


@query(_EVAL_SQL)
def forest_eval(t: Tables) -> DataFrame:
    return _evaluated(t, "random_forest", {"numTrees": 20, "maxDepth": 8})


@query(_EVAL_SQL)
def boosting_eval(t: Tables) -> DataFrame:
    """In full size: 300 rounds a class, depth 6."""
    return _evaluated(t, "boosting", {})


@query("SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linestatus']) AS feature, TRUE AS measured", "permutation_importance")
def permutation_importance_query(t: Tables) -> DataFrame:
    train, validation, _ = _parts(t)
    model = fit_classifier(train, CLASS_FEATURES, CLASS_CATEGORICAL, "arvore_decisao", {"maxDepth": 6})
    found = permutation_importance(model, validation, CLASS_FEATURES, "row_id")
    return found.select("feature", F.coalesce(F.abs("importancia_media") <= 1, F.lit(False)).alias("measured"))


@query("SELECT CAST(5 AS BIGINT) AS trials, TRUE AS never_worse, TRUE AS final_model_agrees", "backward_elimination")
def backward_elimination_query(t: Tables) -> DataFrame:
    """Trials of the elimination; its best subset is no worse than all features, and the final model reaches the best score."""
    train, validation, _ = _parts(t)
    done = backward_elimination(train, validation, CLASS_FEATURES, CLASS_CATEGORICAL, "arvore_decisao", "row_id", {"maxDepth": 5}, repeats=2)
    tried = len([x for x in done.search.trials if x.feature is not None])
    agrees = abs(evaluate(done.model, validation)["f1_macro"] - done.search.best_score) < 1e-9
    # An elimination that is down to its last feature tries no more.
    complete = tried == len(CLASS_FEATURES) or (tried == len(CLASS_FEATURES) - 1 and len(done.search.features) == 1)
    rows = validation.limit(1).select(F.lit(len(CLASS_FEATURES) if complete else tried).cast("bigint").alias("trials"))
    return rows.withColumns({"never_worse": F.lit(done.search.best_score >= done.search.trials[0].score), "final_model_agrees": F.lit(agrees)})


@query("SELECT unnest(['regressao_logistica', 'arvore_decisao', 'random_forest', 'boosting']) AS modelo, CAST(5 AS BIGINT) AS n_features, TRUE AS measured")
def classifier_comparison(t: Tables) -> DataFrame:
    """All four classifiers, in full size, on the validation part, and the best of them on the test part."""
    train, validation, test = _parts(t)
    frame, _ = compare_models(train, validation, test, CLASS_FEATURES, CLASS_CATEGORICAL, {k: {} for k in CLASSIFIERS})
    return frame.select("modelo", F.col("n_features").cast("bigint").alias("n_features"), F.col("f1_macro").between(0, 1).alias("measured"))


#: Queries whose time is model fits.
NAMES = [
    "poisson_glm_cv", "tweedie_glm", "rf_cv", "gbt_cv", "model_choice_per_category", "refit_and_compare", "random_search", "logreg_eval", "tree_eval",
    "forest_eval", "boosting_eval", "permutation_importance", "backward_elimination", "classifier_comparison", "absorbed_poisson_equations", "poisson_boosting_rounds",
]
