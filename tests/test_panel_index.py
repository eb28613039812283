from datetime import date
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from muniframe.operators.aggregates import class_report, confusion_metrics, histogram, two_level_mean
from muniframe.operators.series import fill_panel
from muniframe.plans.index import composite_index, maxmin, minmax, normalize, quantile_class, ranking, weight_grid, weight_sensitivity
from muniframe.plans.metrics import best_per_group, fold_metrics, forecast_metrics, summarize_folds
from muniframe.plans.panel import (
    BASELINES, TemporalFolds, assign_folds, dense_panel, model_features, monthly_counts, naive_baselines, temporal_features,
)
from muniframe.plans.stats import effect_intercepts, ols_by, ols_fixed_effects, ols_summary, regression_line, unit_year_rates

CATS = ["A", "B"]


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(3)
    months = pd.date_range("2015-01-01", "2017-12-01", freq="MS")
    rows = [(u, m.date().replace(day=5), c) for u, m, c in product(["x", "y", "z"], months, CATS) for _ in range(int(rng.poisson(1.2)))]
    return rows + [("x", date(2016, 3, 9), "OTHER"), (None, date(2016, 3, 9), "A")]


@pytest.fixture(scope="module")
def panel(spark, events):
    df = spark.createDataFrame(events, "u string, d date, c string")
    return dense_panel(monthly_counts(df, "u", "d", "c"), CATS).persist()


def test_dense_panel_counts(panel, events):
    got = panel.toPandas()
    kept = [e for e in events if e[0] and e[2] in CATS]
    months = {e[1].replace(day=1) for e in kept}
    span = (max(months).year - min(months).year) * 12 + max(months).month - min(months).month + 1
    assert len(got) == 3 * span * 2 and got["y"].sum() == len(kept)
    assert not got.duplicated(["unit", "data", "categoria"]).any()


def test_dense_panel_spans_all_events(spark):
    rows = [("x", date(2020, 2, 3), "A"), ("w", date(2020, 5, 3), "OTHER"), ("x", date(2019, 12, 31), "OTHER")]
    dense = dense_panel(monthly_counts(spark.createDataFrame(rows, "u string, d date, c string"), "u", "d", "c"), CATS)
    assert dense.count() == 2 * 6 * 2 and dense.agg(F.sum("y")).first()[0] == 1
    bounded = dense_panel(monthly_counts(spark.createDataFrame(rows, "u string, d date, c string"), "u", "d", "c"), CATS, (date(2020, 1, 1), date(2020, 3, 1)))
    assert bounded.count() == 2 * 3 * 2 and bounded.agg(F.sum("y")).first()[0] == 1


def test_history_against_pandas(panel):
    got = naive_baselines(temporal_features(panel)).toPandas().sort_values(["unit", "categoria", "data"]).reset_index(drop=True)
    g = got.groupby(["unit", "categoria"])["y"]
    want = {f"lag_{k}": g.shift(k) for k in (1, 2, 3, 6, 12)}
    want |= {f"media_{k}": g.transform(lambda s, k=k: s.shift(1).rolling(k, min_periods=1).mean()) for k in (3, 6, 12)}
    want["media_historica"] = g.transform(lambda s: s.shift(1).expanding(min_periods=1).mean())
    for name, series in want.items():
        assert np.allclose(got[name].astype(float), series.astype(float), equal_nan=True), name
    for name, source in BASELINES.items():
        assert np.allclose(got[name], want[source].fillna(want["media_historica"]).fillna(0))


def test_model_features_time_index(panel):
    rows = model_features(temporal_features(panel)).toPandas()
    assert rows["data"].min() == date(2016, 1, 1) and rows["tempo"].min() == 13
    assert np.allclose(rows["mes_sin_1"], np.sin(2 * np.pi * rows["mes"] / 12)) and np.allclose(rows["log1p_lag_1"], np.log1p(rows["lag_1"]))


@pytest.mark.parametrize("window,step", [(1, 1), (3, 3), (1, 3), (6, 2), (12, 5)])
def test_folds_against_masks(panel, window, step):
    folds = TemporalFolds(date(2016, 4, 1), date(2017, 12, 1), window, step)
    data = [r[0] for r in panel.select("data").collect()]
    want, start, i = {}, pd.Timestamp("2016-04-01"), 0
    while start <= pd.Timestamp("2017-12-01"):
        i += 1
        stop = start + pd.DateOffset(months=window)
        want[i] = sum(start <= pd.Timestamp(d) < stop for d in data)
        assert (folds.start_of(i), folds.end_of(i)) == (start.date(), stop.date())
        start += pd.DateOffset(months=step)
    assert folds.count == i
    got = {r["fold"]: r["n"] for r in assign_folds(panel, folds).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert folds.validation(panel, 2).count() == want.get(2, 0)


def test_metrics_edge_cases(spark):
    rows = [("a", 1, 2.0), ("a", 3, None), ("a", 2, float("nan")), ("a", 4, 1.0), ("zero", 0, 1.0), ("none", 5, None)]
    got = {r["g"]: r for r in forecast_metrics(spark.createDataFrame(rows, "g string, y int, p double"), "y", "p", ["g"]).collect()}
    a = got["a"]
    assert (a["MAE"], a["RMSE"], a["WAPE"], a["BIAS"], a["TOTAL_REAL"], a["TOTAL_PREVISTO"]) == (2.0, pytest.approx(5**0.5), 0.8, -0.4, 5.0, 3.0)
    assert got["zero"]["WAPE"] is None and got["zero"]["MAE"] == 1.0
    assert got["none"]["MAE"] is None and got["none"]["TOTAL_REAL"] is None


def test_fold_mean_differs_from_pooled(spark, panel):
    base = naive_baselines(temporal_features(panel))
    folds = TemporalFolds(date(2017, 1, 1), date(2017, 12, 1))
    per_fold = fold_metrics(base, folds, "y", list(BASELINES))
    assert per_fold.count() == 12 * 6
    summary = {r["modelo"]: r for r in summarize_folds(per_fold, ["modelo"]).collect()}
    pooled = forecast_metrics(assign_folds(base, folds), "y", "baseline_media_6m").first()
    assert summary["baseline_media_6m"]["TOTAL_REAL"] == pooled["TOTAL_REAL"]
    assert summary["baseline_media_6m"]["MAE"] == pytest.approx(pooled["MAE"])  # folds have equal size
    best = best_per_group(summarize_folds(per_fold, ["modelo"]).withColumn("g", F.lit(1)), ["g"], "WAPE", "modelo").first()
    assert best["WAPE"] == min(r["WAPE"] for r in summary.values())


def test_fill_panel_parity_against_pandas(spark):
    rng = np.random.default_rng(5)
    rows = [(u, c, date(2020, m, 1), None if u == "b" or rng.random() < 0.5 else float(rng.integers(9))) for u in "abcd" for c in "pq" for m in (1, 2, 3)]
    pdf = pd.DataFrame(rows, columns=["unit", "categoria", "data", "v"]).sort_values(["unit", "categoria", "data"])
    want = pdf.groupby("unit")["v"].ffill().bfill()
    df = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in rows], "unit string, categoria string, data date, v double")
    got = fill_panel(df, "unit", "categoria", "data", ["v"]).toPandas().sort_values(["unit", "categoria", "data"])
    assert np.allclose(got["v"].astype(float).to_numpy(), want.to_numpy(), equal_nan=True)


def test_weight_grid():
    grid = weight_grid(6, 0.1, 0.1)
    assert len(grid) == 126 and all(sum(v) == pytest.approx(1) and min(v) >= 0.1 for v in grid)
    small = [tuple(round(w * 10) for w in v) for v in weight_grid(3, 0.1, 0.0)]
    assert small == [c for c in product(range(11), repeat=3) if sum(c) == 10]
    assert weight_grid(3, 0.5, 0.5) == []


def test_index_and_sensitivity(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"u": [f"u{i:02d}" for i in range(23)], **{c: rng.random(23) for c in "abc"}, "k": 1.0})
    df = spark.createDataFrame(pdf)
    norm = normalize(df, ["a", "k"], ["b"]).toPandas()
    assert np.allclose(norm["a_norm"], (pdf["a"] - pdf["a"].min()) / (pdf["a"].max() - pdf["a"].min()))
    assert np.allclose(norm["b_norm"], (pdf["b"].max() - pdf["b"]) / (pdf["b"].max() - pdf["b"].min())) and (norm["k_norm"] == 0).all()
    assert minmax(df, ["a"]).columns[-1] == "a_norm" and maxmin(df, ["a"]).where("a_norm between 0 and 1").count() == 23
    score = df.select(composite_index(["a", "b"]).alias("m"), composite_index(["a", "b"], {"a": 0.25, "b": 0.75}).alias("w")).toPandas()
    assert np.allclose(score["m"], 50 * (pdf["a"] + pdf["b"])) and np.allclose(score["w"], 25 * pdf["a"] + 75 * pdf["b"])

    grid = weight_grid(3, 0.1, 0.1)
    got = weight_sensitivity(df, "u", ["a", "b", "c"], grid).toPandas().set_index("u").sort_index()
    scores = pd.DataFrame(100 * pdf[["a", "b", "c"]].to_numpy() @ np.array(grid).T, index=pdf["u"]).round(9)
    ranks = scores.rank(ascending=False, method="min")
    assert np.allclose(got["rank_medio"], ranks.mean(axis=1)) and np.allclose(got["rank_mediano"], ranks.median(axis=1))
    assert np.allclose(got["desvio_rank"], ranks.std(axis=1)) and np.allclose(got["rank_p05"], ranks.quantile(0.05, axis=1))
    assert np.allclose(got["freq_top10"], (ranks <= 10).mean(axis=1)) and np.allclose(got["freq_bottom10"], (ranks >= 23 - 9).mean(axis=1))
    order = ranking(df, "u", "a").orderBy("ranking").toPandas()
    assert order["u"].tolist() == pdf.sort_values("a", ascending=False)["u"].tolist()


def test_quartile_rules(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    inclusive = {r["v"]: r["classe"] for r in quantile_class(df, "v").collect()}
    assert inclusive == {1.0: "IQV baixo", 2.0: "IQV baixo", 3.0: "IQV médio", 4.0: "IQV alto", 5.0: "IQV alto", None: "Sem dados"}
    strict = {r["v"]: r["classe"] for r in quantile_class(df, "v", False, ("L", "M", "H")).collect()}
    assert strict == {1.0: "L", 2.0: "M", 3.0: "M", 4.0: "M", 5.0: "H", None: "M"}


def test_two_level_mean_is_year_balanced(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 10.0)], "u string, y int, v double")
    assert two_level_mean(df, "u", "y", ["v"]).first()["v"] == 5.0


def test_histogram(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    got = {r["bin"]: r["n"] for r in histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect()}
    counts, _ = np.histogram(x, bins=15)
    assert [got.get(i + 1, 0) for i in range(15)] == counts.tolist()
    assert histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()[0]["n"] == 2


def test_regressions(spark):
    rng = np.random.default_rng(4)
    year = rng.integers(0, 4, 80)
    x = rng.normal(size=80)
    y = 2.0 * x + 3.0 * year + rng.normal(size=80)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(year, x, y)], "ano int, x double, y double")
    design = np.column_stack([x, np.ones(80)])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rss[0] / 78 * np.linalg.inv(design.T @ design)[0, 0])
    row = ols_by(df, "x", ["y"]).first()
    assert (row["slope"], row["intercept"], row["slope_se"]) == (pytest.approx(beta[0]), pytest.approx(beta[1]), pytest.approx(se))
    summary = ols_summary(df, ["x"], "y")
    assert summary["coefficients"]["x"] == pytest.approx(beta[0]) and summary["p_values"]["x"] < 0.05

    fixed = np.column_stack([x, *[(year == k).astype(float) for k in range(4)]])
    beta, rss, *_ = np.linalg.lstsq(fixed, y, rcond=None)
    row = ols_fixed_effects(df, "x", "y", "ano").first()
    assert row["slope"] == pytest.approx(beta[0]) and row["r2"] == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    assert row["slope_se"] == pytest.approx(np.sqrt(rss[0] / 75 * np.linalg.inv(fixed.T @ fixed)[0, 0]))
    effects = {r["ano"]: r["intercept"] for r in effect_intercepts(df, "x", "y", "ano").collect()}
    assert [effects[k] for k in range(4)] == pytest.approx(beta[1:])
    line = regression_line(df, "x", "y", 5).toPandas()
    assert len(line) == 5 and line["x"].min() == pytest.approx(x.min())


def test_rates(spark):
    df = spark.createDataFrame([("a", 1, 100, 5.0, 1, 0), ("a", 1, 100, 5.0, 1, 1), ("b", 1, 0, 6.0, 1, 0)], "u string, y int, pop int, iqv double, p int, q int")
    rows = {r["u"]: r for r in unit_year_rates(df, "u", "y", "pop", "iqv", ["p", "q"]).collect()}
    assert (rows["a"]["p_10k"], rows["a"]["CRIMES_ANALISADOS_TOTAL"], rows["a"]["CRIMES_ANALISADOS_10k"]) == (200.0, 3.0, 300.0)
    assert rows["b"]["p_10k"] is None


def test_class_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "a")]
    df = spark.createDataFrame(pairs, "l string, p string")
    rows = {r["class"]: r for r in class_report(df, "l", "p").collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"]) == (pytest.approx(1 / 3), 0.5)
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"], rows["c"]["support"]) == (0, 0, 0, 2)
    total = confusion_metrics(df, "l", "p").first()
    f1 = {"a": 0.4, "b": 2 / 3, "c": 0.0}
    assert total["accuracy"] == 0.4 and total["f1_macro"] == pytest.approx(sum(f1.values()) / 3)
    assert total["f1_weighted"] == pytest.approx((2 * f1["a"] + f1["b"]) / 5)
