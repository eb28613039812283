"""Models that are sums: score equations, agreement with dense fits, folds equal to their own fits."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from muniframe.operators.ordering import numbered_as_stored, shuffled_number
from muniframe.plans.boosting import fit_poisson_boosting
from muniframe.plans.linear import fit_absorbed, linear_cv
from muniframe.plans.models import one_hot_stages
from muniframe.plans.panel import TemporalFolds


def counts(seed, rows=1500, units=12):
    rng = np.random.default_rng(seed)
    unit, kind = rng.integers(0, units, rows), rng.integers(0, 3, rows)
    a, b = rng.normal(0, 1, rows) + unit / units, rng.normal(3, 2, rows)
    y = rng.poisson(np.exp(0.2 + unit / 8 - 0.5 * kind + 0.3 * a - 0.1 * b))
    return [(f"u{u}" if u else None, f"k{k}", float(x), float(z), int(c)) for u, k, x, z, c in zip(unit, kind, a, b, y)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(counts(1), "unit string, kind string, a double, b double, y int").cache()


def test_score_equations(df):
    """Fitted totals are the actual ones for every level, and products with the numeric columns too."""
    model = fit_absorbed(df, ["unit", "kind"], ["a", "b"])
    fitted = model.predict(df)
    for level in ("unit", "kind"):
        for r in fitted.groupBy(level).agg(F.sum("y").alias("real"), F.sum("y_pred").alias("fit")).collect():
            assert r.fit == pytest.approx(r.real, rel=1e-5)
    sums = fitted.agg(*[F.sum(F.col(c) * (F.col("y") - F.col("y_pred"))) for c in ("a", "b")]).first()
    assert max(map(abs, sums)) < 1e-2 and model.gap <= 1e-7


@pytest.mark.parametrize("power", [1.0, 1.5])
def test_agrees_with_a_dense_fit(df, power):
    """The same predictions as a regression on one-hot vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    named = df.fillna("none", ["unit"])
    family = {"family": "poisson", "link": "log"} if power == 1 else {"family": "tweedie", "variancePower": power, "linkPower": 0.0}
    stages = [*one_hot_stages(["unit", "kind"]), VectorAssembler(inputCols=["a", "b", "unit__hot", "kind__hot"], outputCol="features")]
    dense = Pipeline(stages=[*stages, GeneralizedLinearRegression(featuresCol="features", labelCol="y", predictionCol="p", maxIter=60, tol=1e-10, regParam=1e-9, **family)]).fit(named)
    ours = fit_absorbed(named, ["unit", "kind"], ["a", "b"], power=power).predict(dense.transform(named))
    assert ours.agg(F.max(F.abs(F.col("y_pred") - F.col("p")) / F.col("p"))).first()[0] < 1e-3


def test_levels_without_limit(spark):
    """More levels than a one-hot vector should have, empty and unseen ones, no numeric column."""
    df = spark.range(30_000).selectExpr("id % 10000 AS level", "CAST(id % 3 AS INT) AS kind", "CASE WHEN id % 10000 < 5 THEN 0 ELSE id % 7 END AS y")
    model = fit_absorbed(df, ["level", "kind"], gap=1e-6)
    fitted = model.predict(df)
    wrong = fitted.groupBy("level").agg((F.abs(F.sum("y") - F.sum("y_pred")) > 1e-3).alias("off")).where("off").count()
    assert wrong == 0 and fitted.where("level < 5").agg(F.max("y_pred")).first()[0] == 0
    new = spark.createDataFrame([(-1, 0), (7, 0)], "level long, kind int")
    assert model.predict(new).where("y_pred > 0").count() == 2
    assert math.isfinite(fit_absorbed(df.limit(0), ["kind"]).gap)


def test_folds_equal_their_own_fits(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", date(2020 + m // 12, m % 12 + 1, 1), rng.gauss(0, 1) + g, float(m), 5.0, rng.gauss(m / 9, 1) + g) for g in range(3) for m in range(30) for _ in range(6)]
    rows.append(("g0", date(2020, 3, 1), None, 1.0, 5.0, 9.0))
    df = spark.createDataFrame(rows, "g string, data date, a double, t double, flat double, y double")
    folds = TemporalFolds(date(2020, 1, 1), date(2022, 4, 1), window=2, step=3)
    got = linear_cv(df, folds, ["a", "t", "flat"], by=["g"], keep=["a", "t"]).where("a IS NOT NULL").collect()
    assert len({r.fold for r in got}) == folds.count
    for r in got:
        train = [x for x in rows if x[0] == r.g and x[1] < folds.start_of(r.fold) and x[2] is not None]
        if not train:
            assert r.y_pred is None
            continue
        x = np.array([[1, t[2], t[3]] for t in train])
        if len({t[1] for t in train}) < 2:
            continue
        beta = np.linalg.lstsq(x, np.array([t[5] for t in train]), rcond=None)[0]
        assert r.y_pred == pytest.approx(float(beta @ [1, r.a, r.t]), abs=1e-6)
    pooled = linear_cv(df, folds, ["t"]).where("fold = 4")
    train = [x for x in rows if x[1] < folds.start_of(4) and x[2] is not None or x[1] < folds.start_of(4)]
    slope, cut = np.polyfit([t[3] for t in train], [t[5] for t in train], 1)
    assert pooled.first().y_pred == pytest.approx(cut + slope * ((pooled.first().data.year - 2020) * 12 + pooled.first().data.month - 1))


def test_poisson_boosting(spark):
    """Totals hold after every round, the deviance falls and is the one of the forecasts, and a signal is found that a mean has not."""
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 3, 1200), rng.uniform(0, 1, 1200)
    y = rng.poisson(np.exp(0.5 + np.where(a > 1.5, 1.2, 0) + 0.3 * b))
    df = spark.createDataFrame([(float(p), float(q), int(c)) for p, q, c in zip(a, b, y)] + [(None, 0.5, 3)], "a double, b double, y int")
    model = fit_poisson_boosting(df, ["a", "b"], rounds=8, step=0.3, depth=2)
    assert all(t == pytest.approx(y.sum(), rel=1e-9) for t in model.totals)
    assert all(later < earlier for earlier, later in zip(model.deviance, model.deviance[1:]))
    got = model.predict(df).collect()
    assert [r.y_pred is None for r in got].count(True) == 1
    real, fit = (np.array(v, float) for v in zip(*[(r.y, r.y_pred) for r in got if r.y_pred is not None]))
    own = 2 * np.sum(np.where(real > 0, real * np.log(np.maximum(real, 1e-300) / fit), 0) - (real - fit))
    assert own == pytest.approx(model.deviance[-1]) and own < 0.75 * model.deviance[0] and fit.sum() == pytest.approx(real.sum())
    with pytest.raises(ValueError, match="positive total"):
        fit_poisson_boosting(df.withColumn("y", F.lit(0)), ["a"], rounds=1)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000])
def test_keyed_bijection(spark, size):
    rows = spark.range(size, numPartitions=3).withColumn("key", F.explode(F.array(F.lit(1), F.lit(2))))
    got = rows.select("id", "key", shuffled_number(F.col("id"), F.lit(size).cast("bigint"), F.col("key")).alias("to")).collect()
    for key in (1, 2):
        assert sorted(r.to for r in got if r.key == key) == list(range(size))
    if size == 1000:
        assert sum(r.to == r.id for r in got) < 12 and sum(r.to < 500 and r.id < 500 for r in got if r.key == 1) in range(200, 300)
        numbers = [r.n for r in numbered_as_stored(spark.range(1000, numPartitions=7).where("id % 3 = 0"), "n").collect()]
        assert sorted(numbers) == list(range(334))
