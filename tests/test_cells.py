from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniframe.operators import ordering
from muniframe.operators.ordering import exact_medians, shuffled_number
from muniframe.plans import cells, classify
from muniframe.plans.classify import Preparation, backward_elimination, evaluate, fit_classifier, permutation_importance
from muniframe.workload import model_queries

FEATURES, CATS = ["a", "b", "kind"], ["kind"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes on a number of few values, one of many values in coarse steps with gaps, and a category with a null."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(1500):
        a, b, kind = int(rng.integers(0, 9)), float(rng.integers(0, 20)) * 1.5, "uvw"[rng.integers(0, 3)]
        label = float((a > 4) + (kind == "w" and b > 12)) if rng.random() < 0.85 else float(rng.integers(0, 3))
        out.append((i, float(a) if i % 50 else None, b, kind if i % 70 else None, label))
    return spark.createDataFrame(out, "id long, a double, b double, kind string, label double").repartition(3).persist()


def predicted(model, df):
    return [r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()]


@pytest.mark.parametrize("kind,params", [
    ("arvore_decisao", {"maxDepth": 4}), ("boosting", {"maxIter": 4, "maxDepth": 3, "subsamplingRate": 1.0}), ("random_forest", {"numTrees": 40, "maxDepth": 5}),
])
def test_counts_give_the_models_of_rows(rows, monkeypatch, kind, params):
    """Without draws the same classes as Spark ML on rows; a forest draws otherwise, by the same law."""
    fitted = fit_classifier(rows, FEATURES, CATS, kind, params)
    assert isinstance(fitted.stages[-1], cells.CellModel)
    monkeypatch.setattr(cells, "GRID", 1)
    plain = fit_classifier(rows, FEATURES, CATS, kind, params)
    assert not isinstance(plain.stages[-1], cells.CellModel)
    same = np.mean(np.array(predicted(fitted, rows)) == np.array(predicted(plain, rows)))
    assert same > (0.94 if kind == "random_forest" else 0.999)


def test_draws_have_the_law_of_rows():
    """A cell of many rows is drawn as its rows are: never all or none of them, as one draw for a whole cell would be."""
    x = np.asfortranarray(np.array([[0], [1]], np.uint8))
    counts = np.array([[600, 400], [300, 700]])
    first = next(cells._boosted(x, counts, np.ones(2), 0, {"maxIter": 1, "stepSize": 0.1, "maxDepth": 1, "subsamplingRate": 0.8}))
    leaves = first.value[first.feature < 0]
    assert leaves == pytest.approx([0.2, -0.4], abs=0.1) and (leaves != [0.2, -0.4]).all()


def test_deep_levels_and_tables_agree():
    """A level's cuts come from a table of all bins or from sorted bins, with the same sums."""
    rng = np.random.default_rng(2)
    node, bins, n = rng.integers(0, 40, 900), rng.integers(0, 8, 900), rng.integers(1, 9, 900)
    table = cells._left(node, bins, n, [n * 2.0], 40, 8)
    wide = cells._left(node * 10, bins, n, [n * 2.0], 400, 8)
    of = lambda found, by: {(a // by, b): (c, d) for a, b, c, d in zip(found[0].tolist(), found[1].tolist(), found[2].tolist(), found[3][:, 0].tolist())}
    want, got = of(table, 1), of(wide, 10)
    assert len(got) > 200 and all(want[k] == v for k, v in got.items() if k[1] < 7)


def test_cuts_by_buckets_and_by_sketch(spark):
    """Equal counts in every bin, one bin per value of few, and a column whose deviation one outlier makes."""
    df = spark.range(4000).select(
        F.col("id").cast("double").alias("many__scaled"), (F.col("id") % 7).cast("double").alias("few__scaled"),
        F.when(F.col("id") == 0, 1e18).otherwise(F.col("id") % 50).alias("far__scaled"), F.lit(None).cast("double").alias("none__scaled"),
    )
    many, few, far, none = (a.cuts for a in cells.fit_axes(df, ["many", "few", "far", "none"], []))
    assert len(many) == 31 and np.diff(many) == pytest.approx(125, abs=6) and few == (0.5, 1.5, 2.5, 3.5, 4.5, 5.5) and len(far) > 25 and none == ()


@pytest.mark.parametrize("looked_at", [200_000, 2])
def test_exact_medians(spark, monkeypatch, looked_at):
    monkeypatch.setattr(ordering, "LOOKED_AT", looked_at)
    rng = np.random.default_rng(7)
    for n in (1, 2, 501, 800):
        data = {"x": rng.normal(size=n), "y": np.exp(5 * rng.normal(size=n)), "z": rng.integers(0, 3, n) * 1e9 + 5}
        df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())] + [(None, None, float("nan"))], "x double, y double, z double")
        assert exact_medians(df.withColumn("w", F.lit(None).cast("double")), ["x", "y", "z", "w"]) == pytest.approx({c: float(np.median(v)) for c, v in data.items()})
    assert exact_medians(df.withColumn("x", F.when(F.col("y") > 1, F.col("x")).otherwise(float("inf"))), ["x"]).keys() == {"x"}


def test_bijection_hashes_as_spark(spark):
    got = spark.range(-3, 500).select(F.xxhash64("id", F.lit(7), F.lit(-2)).alias("h")).toPandas()["h"].to_numpy()
    mine = ordering._xxhash64(np.uint64(42), np.arange(-3, 500))
    for k in (7, -2):
        mine = ordering._xxhash64(mine, np.full(1, k, np.int32))
    assert (mine.view(np.int64) == got).all()
    with pytest.raises(Exception, match="whole numbers"):
        spark.range(3).select(shuffled_number(F.col("id"), F.lit(3), F.lit("a"))).collect()


def test_elimination_fits_on_counts(rows, monkeypatch):
    """Trials read counts: no estimator passes over the rows, and scores are those of the rows."""
    monkeypatch.setattr(classify, "classifier", lambda *_: pytest.fail("an estimator was fitted on rows"))
    done = backward_elimination(rows, rows, FEATURES, CATS, "arvore_decisao", "id", {"maxDepth": 4}, repeats=2)
    assert evaluate(done.model, rows)["f1_macro"] == pytest.approx(done.search.best_score, abs=1e-12)
    with Preparation(rows, FEATURES, CATS) as ready:
        model = ready.fit("arvore_decisao", {"maxDepth": 4}, ["kind", "b"])
        assert ready.evaluate(model, rows, ready.counted(rows)) == pytest.approx(evaluate(model, rows))


def test_importance_of_coded_rows(rows, monkeypatch):
    """Shuffled parts of codes score as shuffled columns do."""
    model = fit_classifier(rows, FEATURES, CATS, "arvore_decisao", {"maxDepth": 4})
    of = lambda: {r["feature"]: r["importancia_media"] for r in permutation_importance(model, rows, FEATURES, "id", repeats=3).collect()}
    coded = of()
    monkeypatch.setattr(classify, "CellModel", type("Other", (), {}))
    assert coded == pytest.approx(of()) and coded["a"] > 0.1


@pytest.fixture(scope="module")
def lines(spark):
    """The table of lines as the workload reads it."""
    rng = np.random.default_rng(11)
    rows = [
        (i, i % 17, i % 5, i % 3, float(rng.integers(1, 6)), float(rng.integers(1, 9)), i % 3 / 100, i % 2 / 100, "ANR"[rng.integers(0, 3)], "FO"[i % 2]) for i in range(240)
    ]
    names = "orderkey long, partkey long, suppkey long, linenumber int, quantity double, extendedprice double, discount double, tax double, returnflag string, linestatus string"
    table = spark.createDataFrame(rows, ", ".join(f"l_{n}" for n in names.split(", "))).persist()
    return SimpleNamespace(lineitem=table, spark=spark)


def full_size(monkeypatch):
    """Settings that trees were grown with, and those of estimators on rows."""
    sizes = {}
    on_cells, on_rows = classify.fit_cells, classify.classifier
    monkeypatch.setattr(classify, "fit_cells", lambda spark, kind, settings, found: sizes.update({kind: dict(settings)}) or on_cells(spark, kind, settings, found))
    monkeypatch.setattr(classify, "classifier", lambda kind, params: sizes.update({kind: {**classify.CLASSIFIERS[kind], **(params or {})}}) or on_rows(kind, params))
    return sizes


def test_boosting_query_takes_all_rounds(lines, monkeypatch):
    sizes = full_size(monkeypatch)
    assert {r["label"] for r in model_queries.boosting_eval(lines).collect() if r["measured"]} == {"A", "N", "R"}
    assert sizes == {"boosting": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8}}


def test_comparison_query_takes_full_sizes(lines, monkeypatch):
    sizes = full_size(monkeypatch)
    assert {r["modelo"] for r in model_queries.classifier_comparison(lines).collect() if r["measured"]} == set(classify.CLASSIFIERS)
    assert sizes == classify.CLASSIFIERS


def test_choice_query_fits_full_sizes(monkeypatch):
    """The forecast models of the choice per category keep the defaults of plans.models."""

    class Asked(Exception):
        pass

    def ask(*args, **_):
        raise Asked(args[2])

    monkeypatch.setattr(model_queries, "_frame", lambda t: None)
    monkeypatch.setattr(model_queries, "cv_models", ask)
    with pytest.raises(Asked) as asked:
        model_queries.model_choice_per_category(None)
    assert asked.value.args[0] == {k: (k, {}) for k in ("poisson_regressor", "random_forest", "gradient_boosting")}
