"""Incident rates against the index: unit-year table and least squares in closed form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import rate_per, ratio, row_sum


def unit_year_rates(
    df: DataFrame, unit: str, year: str, population: str, index: str, categories: Sequence[str], total: str = "CRIMES_ANALISADOS", k: int = 10_000
) -> DataFrame:
    """Counts and rates per ``k`` inhabitants by (unit, year), with the total over categories.

    Population and index are constant per unit and year, so ``min`` stands for any row.
    """
    grouped = df.groupBy(unit, year).agg(
        F.min(population).alias(population), F.min(index).alias(index), *[F.sum(c).alias(c) for c in categories]
    )
    grouped = grouped.withColumn(f"{total}_TOTAL", row_sum(*[F.col(c) for c in categories]))
    rates = {f"{c}_10k": rate_per(F.col(c), F.col(population), k) for c in categories}
    rates[f"{total}_10k"] = rate_per(F.col(f"{total}_TOTAL"), F.col(population), k)
    return grouped.withColumns(rates)


def ols_by(df: DataFrame, x: str, ys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Simple least squares of each ``y`` on ``x``: one aggregate for all models.

    Rows: (by..., response, n, slope, intercept, r2, slope_se, t_value).
    """
    moments = []
    for i, y in enumerate(ys):
        moments += [
            F.regr_count(y, x).alias(f"n{i}"), F.regr_slope(y, x).alias(f"b{i}"), F.regr_intercept(y, x).alias(f"a{i}"),
            F.regr_r2(y, x).alias(f"r{i}"), F.regr_sxx(y, x).alias(f"sxx{i}"), F.regr_syy(y, x).alias(f"syy{i}"), F.regr_sxy(y, x).alias(f"sxy{i}"),
        ]
    fitted = df.groupBy(*by).agg(*moments)
    rows = []
    for i, y in enumerate(ys):
        residual = F.col(f"syy{i}") - F.col(f"b{i}") * F.col(f"sxy{i}")
        se = F.sqrt(ratio(residual, (F.col(f"n{i}") - 2) * F.col(f"sxx{i}")))
        rows.append(F.struct(
            F.lit(y).alias("response"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("slope"), F.col(f"a{i}").alias("intercept"),
            F.col(f"r{i}").alias("r2"), se.alias("slope_se"), ratio(F.col(f"b{i}"), se).alias("t_value"),
        ))
    return fitted.select(*by, F.inline(F.array(*rows)))


def ols_fixed_effects(df: DataFrame, x: str, y: str, effect: str) -> DataFrame:
    """``y ~ x + C(effect)``: slope, R2, n and number of effects, in one row.

    The within-group moments per effect add up to the pooled slope, so the detail
    is read once and only one row per effect value moves on.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(effect).isNotNull())
    groups = both.groupBy(effect).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("ybar"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")
    )
    pooled = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_effects"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"),
        F.sum(F.col("n") * F.col("ybar")).alias("sy"), F.sum(F.col("n") * F.col("ybar") * F.col("ybar")).alias("syy_between"),
    )
    slope = ratio(F.col("sxy"), F.col("sxx"))
    residual = F.col("syy") - slope * F.col("sxy")
    total = F.col("syy") + F.col("syy_between") - F.col("sy") * F.col("sy") / F.col("n")
    df_resid = F.col("n") - F.col("n_effects") - 1
    se = F.sqrt(ratio(residual, df_resid * F.col("sxx")))
    return pooled.select(
        "n", "n_effects", slope.alias("slope"), (1 - ratio(residual, total)).alias("r2"), se.alias("slope_se"), ratio(slope, se).alias("t_value")
    )


def effect_intercepts(df: DataFrame, x: str, y: str, effect: str) -> DataFrame:
    """Intercept of each effect value under the common slope of :func:`ols_fixed_effects`."""
    slope = ols_fixed_effects(df, x, y, effect).select("slope").scalar()
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(effect).isNotNull())
    means = both.groupBy(effect).agg(F.avg(y).alias("ybar"), F.avg(x).alias("xbar"))
    return means.select(effect, (F.col("ybar") - slope * F.col("xbar")).alias("intercept"))


def ols_summary(df: DataFrame, x: Sequence[str], y: str) -> Mapping[str, object]:
    """Coefficients with standard errors, t and p values (normal equations)."""
    ready = VectorAssembler(inputCols=list(x), outputCol="features", handleInvalid="skip").transform(df.dropna(subset=[y]))
    fit = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(ready)
    s = fit.summary
    names = [*x, "intercept"]
    return {
        "coefficients": dict(zip(names, [*fit.coefficients, fit.intercept])),
        "std_errors": dict(zip(names, s.coefficientStandardErrors)),
        "t_values": dict(zip(names, s.tValues)),
        "p_values": dict(zip(names, s.pValues)),
        "r2": s.r2,
        "n": s.numInstances,
    }


def regression_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Evenly spaced points of the fitted line over the range of ``x``."""
    fit = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + step * F.col("i"))
    return grid.select("x", (F.col("a") + F.col("b") * F.col("x")).alias("y"))
