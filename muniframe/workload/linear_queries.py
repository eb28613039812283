"""Models whose fits are sums, over monthly folds and all rows; SQL states their equations and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.boosting import fit_poisson_boosting
from ..plans.linear import fit_absorbed, linear_cv
from .adapters import FOLDS, HISTORY_SQL, features
from .catalog import Tables, query, rounded

ABSORBED = ("unit", "categoria", "mes")


@query(f"""WITH {HISTORY_SQL}, used AS (SELECT *, CAST(month(data) AS VARCHAR) AS mes, (year(data) - (SELECT min(year(data)) FROM hist)) * 12 + month(data) AS tempo FROM hist WHERE lag_12 IS NOT NULL),
rows AS ({' UNION ALL '.join(f"SELECT '{c}' AS effect, CAST({c} AS VARCHAR) AS level, y FROM used" for c in ABSORBED)})
SELECT effect, level, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS DOUBLE) AS real, CAST(sum(y) AS DOUBLE) AS fitted FROM rows GROUP BY 1, 2
UNION ALL SELECT 'tempo', 'mean', CAST(count(*) AS BIGINT), round(sum(tempo * y) * 1.0 / sum(y), 3), round(sum(tempo * y) * 1.0 / sum(y), 3) FROM used""")
def absorbed_poisson_equations(t: Tables) -> DataFrame:
    """A Poisson regression with one effect per unit, category and calendar month and a trend: what it fits sums to what happened, for
    every level and weighted with the trend. A model that is off by a thousandth turns a row red."""
    frame = features(t).withColumn("mes", F.month("data").cast("string")).withColumn("tempo", F.col("tempo").cast("double"))
    fitted = fit_absorbed(frame, ABSORBED, ["tempo"]).predict(frame).persist()
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("real"), F.round(F.sum("y_pred"), 1).alias("fitted")]
    out = None
    for c in ABSORBED:
        part = fitted.groupBy(F.lit(c).alias("effect"), F.col(c).cast("string").alias("level")).agg(*sums)
        out = part if out is None else out.unionByName(part)
    mean = lambda c: F.round(F.sum(F.col("tempo") * F.col(c)) / F.sum(c), 3)
    return out.unionByName(fitted.agg(F.lit("tempo").alias("effect"), F.lit("mean").alias("level"), F.count(F.lit(1)).alias("n"), mean("y").alias("real"), mean("y_pred").alias("fitted")))


@query(f"""WITH {HISTORY_SQL}, used AS (SELECT * FROM hist WHERE lag_12 IS NOT NULL),
folds AS (SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS fold, CAST(s AS DATE) AS start FROM generate_series(DATE '1999-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) g(s)),
fits AS (SELECT fold, start, categoria, regr_slope(y, media_12) AS slope, regr_intercept(y, media_12) AS cut FROM folds JOIN used ON data < start GROUP BY ALL)
SELECT categoria, fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS DOUBLE) AS total_real, round(sum(cut + slope * media_12) + 1e-5, 4) AS total_pred, round(avg(abs(cut + slope * media_12 - y)) + 1e-7, 6) AS mae
FROM fits JOIN used USING (categoria) WHERE data = start GROUP BY 1, 2""")
def linear_monthly_folds(t: Tables) -> DataFrame:
    """Least squares on the twelve-month mean, a model per category on each of 32 expanding monthly folds, from one scan."""
    predicted = linear_cv(features(t), FOLDS, ["media_12"], by=["categoria"], keep=["unit"])
    error = F.avg(F.abs(F.col("y_pred") - F.col("y")))
    return predicted.groupBy("categoria", F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total_real"), rounded(F.sum("y_pred") + 1e-5, 4).alias("total_pred"), rounded(error + 1e-7).alias("mae")
    )


ROUNDS = 8


@query(f"""WITH {HISTORY_SQL} SELECT CAST(r AS BIGINT) AS round, CAST(sum(y) AS DOUBLE) AS total_real, CAST(sum(y) AS DOUBLE) AS total_fitted, TRUE AS deviance_falls
FROM hist CROSS JOIN generate_series(1, {ROUNDS}) AS g(r) WHERE lag_12 IS NOT NULL GROUP BY r
UNION ALL SELECT CAST(0 AS BIGINT), CAST(sum(y) AS DOUBLE), CAST(sum(y) AS DOUBLE), TRUE FROM hist WHERE lag_12 IS NOT NULL""")
def poisson_boosting_rounds(t: Tables) -> DataFrame:
    """Boosting on the Poisson deviance: the total it fits after each round, and whether the deviance fell; round 0 is the forecast of the
    whole model, summed over the rows."""
    frame = features(t).persist()
    model = fit_poisson_boosting(frame, ["lag_1", "media_12", "mes_sin_1", "mes_cos_1", "tempo"], rounds=ROUNDS, step=0.1, depth=3)
    facts = [(k + 1, model.totals[k], model.deviance[k + 1] < model.deviance[k]) for k in range(ROUNDS)]
    real = frame.agg(F.sum(F.col("y").cast("double"))).scalar()
    every = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("round"), F.lit(round(total, 3)).alias("total_fitted"), F.lit(falls).alias("deviance_falls")) for k, total, falls in facts])).alias("r")
    rounds = t.spark.range(1).select(every).select("r.round", real.alias("total_real"), "r.total_fitted", "r.deviance_falls")
    whole = model.predict(frame).agg(F.lit(0).cast("bigint").alias("round"), F.sum(F.col("y").cast("double")).alias("total_real"), F.round(F.sum("y_pred"), 3).alias("total_fitted"), F.lit(True).alias("deviance_falls"))
    return rounds.unionByName(whole)
