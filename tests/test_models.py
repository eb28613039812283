from datetime import date
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from muniframe.plans import classify, models
from muniframe.plans.classify import (
    backward_elimination, compare_models, encode_label, evaluate, fit_classifier, fit_imputer, label_codes, permutation_importance, stratified_split,
)
from muniframe.plans.models import (
    best_models, cv_models, cv_results, fit_count_model, load_model, one_hot_stages, overall_comparison, population_scaler, predict_counts, random_search,
    refit_winners, sample_grid, save_model, winning_predictions, SEARCH_GRID,
)
from muniframe.plans.panel import TemporalFolds

NUMERIC, CATEGORICAL = ["x"], ["unit", "categoria"]
FOLDS = TemporalFolds(date(2020, 7, 1), date(2020, 12, 1), window=3, step=3)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(9)
    rows = []
    for u, c, m in product(["p", "q", "r"], ["A", "B"], pd.date_range("2019-01-01", "2020-12-01", freq="MS")):
        x = float(rng.normal())
        rows.append((u, c, m.date(), x, int(rng.poisson(np.exp(0.5 + 0.6 * x + (c == "B"))))))
    return spark.createDataFrame(rows, "unit string, categoria string, data date, x double, y int").repartition(4).persist()


def test_poisson_recovers_coefficient(series):
    model = fit_count_model(series, "poisson_glm", NUMERIC, CATEGORICAL)
    assert model.stages[-1].coefficients[0] == pytest.approx(0.6, abs=0.1)


@pytest.mark.parametrize("kind,params", [
    ("poisson_regressor", {}), ("tweedie_regressor", {}), ("random_forest", {"numTrees": 5, "maxDepth": 3}),
    ("extra_trees", {"numTrees": 5, "maxDepth": 3}), ("gradient_boosting", {"maxIter": 3}), ("boosted_poisson", {"maxIter": 3}),
])
def test_every_kind_fits_saves_and_predicts(series, tmp_path, kind, params):
    model = fit_count_model(series, kind, NUMERIC, CATEGORICAL, params)
    save_model(model, str(tmp_path / kind))
    unseen = series.withColumn("unit", F.lit("never seen"))
    for df in (series, unseen):
        out = predict_counts(load_model(str(tmp_path / kind)), df, ["y"])
        assert out.count() == series.count() and out.where("y_pred < 0 or y_pred is null").count() == 0


def test_unseen_value_is_all_zero(spark):
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=one_hot_stages(["c"])).fit(spark.createDataFrame([("b",), ("a",)], "c string"))
    rows = {r["c"]: r["c__hot"].toArray().tolist() for r in fitted.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string")).collect()}
    assert rows == {"a": [1, 0], "b": [0, 1], "z": [0, 0]}


def test_cross_validation_uses_only_the_past(series):
    models = {"glm": ("poisson_glm", {}), "l2": ("poisson_regressor", {})}
    pred = cv_models(series, FOLDS, models, NUMERIC, CATEGORICAL).persist()
    assert pred.count() == 2 * 6 * 6 and {r[0] for r in pred.select("fold").distinct().collect()} == {1, 2}
    fold1 = fit_count_model(FOLDS.train(series, 1), "poisson_glm", NUMERIC, CATEGORICAL)
    want = predict_counts(fold1, FOLDS.validation(series, 1), ["unit", "categoria", "data"]).toPandas()
    got = pred.where("modelo = 'glm' and fold = 1").select("unit", "categoria", "data", "y_pred").toPandas()
    both = want.merge(got, on=["unit", "categoria", "data"])
    assert len(both) == 18 and np.allclose(both["y_pred_x"], both["y_pred_y"])
    assert cv_results(pred).count() == 2

    grouped = cv_models(series, FOLDS, models, NUMERIC, CATEGORICAL, {"categoria": ["A", "B"]})
    best = best_models(cv_results(grouped, ["categoria"]))
    assert best.count() == 2 and winning_predictions(grouped, best).count() == 36
    refits = refit_winners(series, {"A": ("poisson_glm", {}), "B": ("poisson_glm", {})}, "categoria", NUMERIC, CATEGORICAL)
    assert set(refits) == {"A", "B"}
    assert overall_comparison({"a": pred, "b": grouped}).count() == 2


def test_fits_run_on_few_partitions(series, monkeypatch):
    """A small panel keeps no partition per shuffle task, cached by the caller or not."""
    seen = []
    fit = models.fit_count_model
    monkeypatch.setattr(models, "fit_count_model", lambda train, *rest: seen.append(train.rdd.getNumPartitions()) or fit(train, *rest))
    wide = series.repartition(60).persist()
    pred = cv_models(wide, FOLDS, {"glm": ("poisson_glm", {})}, NUMERIC, CATEGORICAL)
    assert pred.count() == 2 * 18 and set(refit_winners(wide, {"A": ("poisson_glm", {})}, "categoria", NUMERIC, CATEGORICAL)) == {"A"}
    assert len(seen) == 3 and max(seen) < 20 and wide.is_cached


def test_random_search(series):
    draws = sample_grid(SEARCH_GRID, 20)
    assert len({tuple(sorted(d.items())) for d in draws}) == 20 and draws == sample_grid(SEARCH_GRID, 20)
    summary, trials = random_search(series, FOLDS, {"maxIter": (2, 3), "maxDepth": (2,)}, NUMERIC, CATEGORICAL, {"categoria": ["A"]}, n_iter=5)
    assert len(trials) == 2 and summary.count() == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        a, noise = float(rng.normal()), float(rng.normal())
        label = "hot" if i % 3 == 0 else ("neg" if a < 0 else "pos")
        shift = 4.0 if label == "hot" else 0.0
        rows.append((i, a + shift if i % 10 else None, noise, "u" if label == "hot" else "v", label))
    df = spark.createDataFrame(rows, "id long, a double, noise double, kind string, y string")
    assert label_codes(df, "y") == ["hot", "neg", "pos"]
    return encode_label(df, "y", ["hot", "neg", "pos"]).persist()


def test_stratified_split_is_exact(labelled):
    parts = stratified_split(labelled, "label", "id").persist()
    counts = {(r["label"], r["part"]): r["n"] for r in parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in (0.0, 1.0, 2.0):
        n = sum(counts[k, p] for p in range(3))
        assert abs(counts[k, 0] - 0.6 * n) <= 0.5 and abs(counts[k, 0] + counts[k, 1] - 0.8 * n) <= 0.5
    again = stratified_split(labelled.repartition(7), "label", "id").select("id", "part").toPandas().sort_values("id")
    assert again["part"].tolist() == parts.select("id", "part").toPandas().sort_values("id")["part"].tolist()


def test_imputer_and_scaler(spark):
    df = spark.createDataFrame([(1.0, "x"), (5.0, "y'"), (None, "y'"), (7.0, None), (8.0, None)], "n double, s string")
    filled = fit_imputer(df, ["n"], ["s"]).transform(df).toPandas()
    assert sorted(filled["n"]) == [1.0, 5.0, 6.0, 7.0, 8.0] and filled["s"].tolist().count("y'") == 4
    scaled = population_scaler(filled_df := spark.createDataFrame(filled), ["n"]).transform(filled_df).toPandas()
    assert scaled["n__scaled"].std(ddof=0) == pytest.approx(1) and scaled["n__scaled"].mean() == pytest.approx(0, abs=1e-12)


FEATURES, CATS = ["a", "noise", "kind"], ["kind"]


@pytest.mark.parametrize("kind,params", [
    ("regressao_logistica", {"maxIter": 30}), ("arvore_decisao", {"maxDepth": 4}), ("random_forest", {"numTrees": 5, "maxDepth": 4}), ("boosting", {"maxIter": 2, "maxDepth": 2}),
])
def test_classifiers_learn(labelled, kind, params):
    model = fit_classifier(labelled, FEATURES, CATS, kind, params)
    right = model.transform(labelled).where("prediction = label").count()
    assert right > 0.75 * labelled.count()


def test_models_share_one_preparation(labelled, monkeypatch):
    calls = []
    fill = classify.fit_imputer
    monkeypatch.setattr(classify, "fit_imputer", lambda *a: calls.append(1) or fill(*a))
    sizes = {"arvore_decisao": {"maxDepth": 3}, "regressao_logistica": {"maxIter": 5}}
    table, _ = compare_models(labelled, labelled, labelled, FEATURES, CATS, sizes)
    alone = {k: evaluate(fit_classifier(labelled, FEATURES, CATS, k, p), labelled)["f1_macro"] for k, p in sizes.items()}
    assert len(calls) == 1 + 2 and {r["modelo"]: r["f1_macro"] for r in table.collect()} == pytest.approx(alone)


def test_importance_and_elimination(labelled, tmp_path):
    train, val, test = (stratified_split(labelled, "label", "id").where(F.col("part") == i) for i in range(3))
    model = fit_classifier(train, FEATURES, CATS, "arvore_decisao", {"maxDepth": 4})
    imp = {r["feature"]: r["importancia_media"] for r in permutation_importance(model, val, FEATURES, "id", repeats=3).collect()}
    assert set(imp) == set(FEATURES) and imp["a"] > abs(imp["noise"])
    done = backward_elimination(train, val, FEATURES, CATS, "arvore_decisao", "id", {"maxDepth": 4}, repeats=2, save_to=str(tmp_path / "best"))
    search = done.search
    assert done.importance.count() == 3 and search.best_score >= search.trials[0].score and "a" in search.best
    assert all((t.change >= 0) == t.dropped for t in search.trials[1:])
    assert evaluate(done.model, val)["f1_macro"] == search.best_score == evaluate(load_model(str(tmp_path / "best")), val)["f1_macro"]
    table, tested = compare_models(train, val, test, FEATURES, CATS, {"arvore_decisao": {"maxDepth": 4}, "regressao_logistica": {"maxIter": 20}})
    assert table.count() == 2 and 0 <= tested["accuracy"] <= 1
