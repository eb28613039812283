"""Count and linear models whose fits are sums: no encoded vectors, no limit on the levels of a category.

*Absorbed effects.* A Poisson (or Tweedie) regression with log link and one effect per level of each category. With everything else
fixed, a level's effect has a closed form: its total over its fitted total, weighted by ``mu ** (1 - power)``. So the categories take turns, each
update is one join and one grouped sum, and a level costs a row in a table. Numeric columns take Newton steps in between, from one pass that sums their products.

*Folds from shared sums.* What a least-squares fit needs of its rows are sums of products. They are taken once per month; running
totals over the months then give every expanding fold its fit, so any number of folds costs one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .panel import TemporalFolds, assign_folds

#: Numeric columns that one driver-side system of equations may have.
COLUMNS = 200


def _centred(df: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation (1 where it is 0) of each numeric column."""
    if not numeric:
        return {}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in numeric}


def _products(xs: Sequence[Column], weight: Column) -> list[Column]:
    """Weighted sums of all products of two columns, row by row of the upper triangle."""
    return [F.sum(weight * xs[i] * xs[j]).alias(f"p_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]


def _matrix(row, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"p_{i}_{j}"] or 0.0
    return out


@dataclass(frozen=True)
class AbsorbedModel:
    """``effects``: per category a table (level, effect), effects being factors. ``slopes`` belong to centred and scaled numeric columns."""

    effects: Mapping[str, DataFrame]
    slopes: Mapping[str, float]
    scales: Mapping[str, tuple[float, float]]
    label: str
    rounds: int
    gap: float

    def numeric_part(self) -> Column:
        terms = [(F.col(c).cast("double") - m) / s * F.lit(float(self.slopes[c])) for c, (m, s) in self.scales.items()]
        return F.exp(reduce(lambda a, b: a + b, terms)) if terms else F.lit(1.0)

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """``df`` with the expected count; a level that training lacked has the factor 1 (null levels are a level). Rows stay rows."""
        return _with_effects(df, self.effects).withColumn(out, self.numeric_part() * _product(self.effects)).drop(*[f"__f_{c}" for c in self.effects])


def _with_effects(df: DataFrame, effects: Mapping[str, DataFrame]) -> DataFrame:
    for c, table in effects.items():
        renamed = table.select(F.col("level").alias("__level"), F.col("effect").alias(f"__f_{c}"))
        df = df.join(renamed, F.col(c).eqNullSafe(F.col("__level")), "left").drop("__level").withColumn(f"__f_{c}", F.coalesce(f"__f_{c}", F.lit(1.0)))
    return df


def _product(effects: Mapping[str, DataFrame]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(f"__f_{c}") for c in effects], F.lit(1.0))


def fit_absorbed(
    df: DataFrame, categories: Sequence[str], numeric: Sequence[str] = (), label: str = "y", power: float = 1.0, penalty: float = 0.0,
    rounds: int = 60, gap: float = 1e-7,
) -> AbsorbedModel:
    """Log-link regression of a count on categories of any size and numeric columns; ``power`` 1 is Poisson, between 1 and 2 Tweedie.

    ``penalty`` shrinks the slopes (ridge, on scaled columns, per row); effects are free. Stops when no factor and no slope moves by more than ``gap``.
    At the end every level's weighted residuals sum to zero: for Poisson, fitted totals are the actual ones. Rows without a label are left out; a null category value is a level
    of its own; a level whose labels are all 0 has the factor 0. Numeric columns must not be null.
    """
    if len(numeric) > COLUMNS:
        raise ValueError(f"{len(numeric)} numeric columns; at most {COLUMNS}")
    rows = df.where(F.col(label).isNotNull()).select(*categories, *numeric, F.col(label).cast("double").alias("__y")).persist()
    try:
        scales = _centred(rows, numeric)
        xs = [(F.col(c).cast("double") - m) / s for c, (m, s) in scales.items()]
        mean, n = rows.agg(F.avg("__y"), F.count(F.lit(1))).first()
        effects: dict[str, DataFrame] = {}
        for k, c in enumerate(categories):  # the first category carries the level of all
            start = F.lit(float(mean or 0.0)) if k == 0 else F.lit(1.0)
            effects[c] = stored(rows.groupBy(F.col(c).alias("level")).agg(start.alias("effect")))
        slopes, done, moved = {c: 0.0 for c in numeric}, 0, np.inf
        while done < rounds and moved > gap:
            done, moved = done + 1, 0.0
            for c in categories:
                model = AbsorbedModel(effects, slopes, scales, label, done, moved)
                fitted = model.predict(rows, "__mu")
                weight = F.when(F.col("__mu") > 0, F.pow("__mu", F.lit(1.0 - power))).otherwise(F.lit(0.0))
                sums = fitted.groupBy(F.col(c).alias("level")).agg(F.sum(F.col("__y") * weight).alias("real"), F.sum(F.col("__mu") * weight).alias("fitted"))
                factor = F.when(F.col("fitted") > 0, F.col("real") / F.col("fitted")).otherwise(F.lit(1.0))
                joined = effects[c].join(sums.withColumnRenamed("level", "its"), F.col("level").eqNullSafe(F.col("its")))
                new = stored(joined.select("level", (F.col("effect") * factor).alias("effect"), F.abs(factor - 1).alias("moved")))
                moved = max(moved, new.where("effect > 0").agg(F.max("moved")).first()[0] or 0.0)
                effects = {**effects, c: new.select("level", "effect")}
            if numeric:
                fitted = AbsorbedModel(effects, slopes, scales, label, done, moved).predict(rows, "__mu")
                weight = F.when(F.col("__mu") > 0, F.pow("__mu", F.lit(2.0 - power))).otherwise(F.lit(0.0))
                pull = F.when(F.col("__mu") > 0, (F.col("__y") - F.col("__mu")) * F.pow("__mu", F.lit(1.0 - power))).otherwise(F.lit(0.0))
                row = fitted.agg(*_products(xs, weight), *[F.sum(pull * x).alias(f"g_{i}") for i, x in enumerate(xs)]).first()
                beta = np.array([slopes[c] for c in numeric])
                gradient = np.array([row[f"g_{i}"] or 0.0 for i in range(len(numeric))]) - penalty * n * beta
                step = np.linalg.lstsq(_matrix(row, len(numeric)) + penalty * n * np.eye(len(numeric)), gradient, rcond=None)[0]
                slopes = dict(zip(numeric, (beta + np.clip(step, -2, 2)).tolist()))
                moved = max(moved, float(np.abs(step).max()))
        return AbsorbedModel(effects, slopes, scales, label, done, moved)
    finally:
        rows.unpersist()


# ---- folds from shared sums ---------------------------------------------------------------------


def linear_cv(
    df: DataFrame, folds: TemporalFolds, numeric: Sequence[str], label: str = "y", date: str = "data", by: Sequence[str] = (), penalty: float = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Out-of-fold predictions of a least-squares model (with intercept) on every expanding fold, one model per ``by`` group and fold.

    Returns ``by``, ``keep``, date, label, fold and y_pred. One scan sums the products per month, running totals over the months make the folds' normal equations,
    and each (group, fold) is solved where it lies. Rows with a null in a used column take no part in the sums; their
    prediction is null. ``penalty`` is a ridge on the slopes, per row. Columns that do not vary get the slope 0.
    """
    if len(numeric) > COLUMNS:
        raise ValueError(f"{len(numeric)} numeric columns; at most {COLUMNS}")
    names = ["__one", *[f"__x{i}" for i in range(len(numeric))], "__y"]
    used = df.select(*by, *keep, F.col(date).alias("__date"), F.lit(1.0).alias("__one"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(numeric)], F.col(label).cast("double").alias("__y"))
    size = len(names)
    month = F.trunc("__date", "MM").alias("__month")
    sums = used.dropna(subset=["__date", *names]).groupBy(*by, month).agg(*_products([F.col(c) for c in names], F.lit(1.0)))
    cells = [f"p_{i}_{j}" for i in range(size) for j in range(i, size)]
    # Every fold sees the sums of all months before its start.
    asked = used.select(*by).distinct() if by else df.sparkSession.range(1).select()
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(folds.start_of(k)).alias("start")) for k in range(1, folds.count + 1)])).alias("at")
    marks = asked.select(*by, starts).select(*by, F.col("at.start").alias("__month"), F.col("at.fold").alias("fold"), *[F.lit(0.0).alias(c) for c in cells])
    order = Window.partitionBy(*by).orderBy("__month", F.col("fold").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("fold", F.lit(None).cast("int")).unionByName(marks).withColumns({c: F.sum(c).over(order) for c in cells})
    equations = running.where(F.col("fold").isNotNull()).select(*by, "fold", F.array(*cells).alias("cells"))
    kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "fold int", "beta array<double>"])

    def solve(batches):
        for batch in batches:
            batch["beta"] = [_solved(cells, size, penalty) for cells in batch.pop("cells")]
            yield batch

    solved = equations.mapInPandas(solve, kinds)
    folded = assign_folds(used.withColumnRenamed("__date", date), folds, date)
    same = F.col("fold") == F.col("__fold")
    renamed = solved.withColumnsRenamed({"fold": "__fold", **{c: f"__s_{c}" for c in by}})
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    predicted = folded.join(renamed, same)
    value = reduce(lambda a, b: a + b, [F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(names[:-1])])
    return predicted.select(*by, *keep, date, F.col("__y").alias(label), "fold", value.alias("y_pred"))


def _solved(cells, size: int, penalty: float) -> list[float] | None:
    """Intercept and slopes from the sums of products of (1, columns, label); null without rows."""
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = np.asarray(cells, float)
    full = full + full.T - np.diag(np.diag(full))
    n, p = full[0, 0], size - 2
    if n <= 0:
        return None
    means, target = full[0, 1 : p + 1] / n, full[0, -1] / n
    cross = full[1 : p + 1, 1 : p + 1] - n * np.outer(means, means)
    spread = np.sqrt(np.maximum(np.diag(cross), 0) / n)
    live = spread > 1e-9 * (1 + np.abs(means))
    slopes = np.zeros(p)
    if live.any():
        s = spread[live]
        scaled = cross[np.ix_(live, live)] / np.outer(s, s) + penalty * n * np.eye(int(live.sum()))
        slopes[live] = np.linalg.lstsq(scaled, (full[1 : p + 1, -1] - n * means * target)[live] / s, rcond=1e-12)[0] / s
    return [float(target - means @ slopes), *slopes.tolist()]
