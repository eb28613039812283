"""Group aggregates with explicit null rules, profiles, histograms, confusion metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from ..functions.text import clean_text


def aggregate_units(
    df: DataFrame,
    unit: Sequence[str],
    sums: Sequence[str],
    null_zero: bool = True,
    dim: DataFrame | None = None,
    key: str | None = None,
) -> DataFrame:
    """Roll detail rows up to units, optionally through a detail-to-unit dimension.

    ``null_zero`` gives 0 for an all-null group, otherwise null. Rows without a unit
    are dropped, as a group key may not be null.
    """
    if dim is not None:
        df = df.select(key, *sums).join(dim, key)
    df = df.dropna(subset=list(unit))
    zero = (lambda c: F.coalesce(c, F.lit(0.0))) if null_zero else (lambda c: c)
    return df.groupBy(*unit).agg(*[zero(F.sum(F.col(c).cast("double"))).alias(c) for c in sums])


def mean_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def two_level_mean(df: DataFrame, unit: str, year: str, cols: Sequence[str]) -> DataFrame:
    """Mean per (unit, year), then mean of the yearly means."""
    return mean_by(mean_by(df, [unit, year], cols), [unit], cols)


def profile_distinct(df: DataFrame, cols: Sequence[str], clean: bool = False) -> DataFrame:
    """Distinct non-null values per column in one pass: (column, value)."""
    values = [F.struct(F.lit(c).alias("column"), (clean_text(F.col(c)) if clean else F.col(c).cast("string")).alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*values)))
    return long.where(F.col("value").isNotNull()).distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share per value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.where(F.col(col).isNotNull()).agg(F.sum("n"))
    return counts.withColumn("share", F.when(F.col(col).isNotNull(), F.col("n") / total.scalar()))


def bounds(df: DataFrame, cols: Sequence[str]) -> Column:
    """One struct ``{c_lo, c_hi, ...}`` of column extremes, as a scalar subquery."""
    fields = [f(F.col(c).cast("double")).alias(f"{c}_{s}") for c in cols for f, s in ((F.min, "lo"), (F.max, "hi"))]
    return df.agg(F.struct(*fields)).scalar()


def histogram(df: DataFrame, col: str, bins: int = 15) -> DataFrame:
    """Equal-width bins; the last bin includes the maximum; empty bins are not listed."""
    value = F.col(col).cast("double")
    ranged = df.where(value.isNotNull()).select(value.alias("x"))
    tagged = ranged.withColumn("b", bounds(ranged, ["x"])).select("x", "b.x_lo", "b.x_hi")
    width = (F.col("x_hi") - F.col("x_lo")) / bins
    index = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col("x") - F.col("x_lo")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)))
    return (
        tagged.withColumn("bin", index.cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.col("x_lo") + (F.col("bin") - 1) * width).alias("left_edge"))
        .select("bin", "left_edge", "n")
    )


def confusion_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Rows by class and predicted class; ``rows`` is a column that says how many rows one row stands for."""
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(n.alias("n"))


def class_report(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where undefined.

    Works on the confusion counts, whose size is classes squared.
    """
    counts = confusion_counts(df, label, pred, by, rows)
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(none)
    as_actual = F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("actual"), none.alias("predicted"))
    as_predicted = F.struct(F.col("pred").alias("class"), none.alias("tp"), none.alias("actual"), F.col("n").alias("predicted"))
    per_row = counts.select(*by, F.inline(F.array(as_actual, as_predicted)))
    totals = per_row.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("tp").cast("double"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("tp").cast("double"), F.col("actual")), zero)
    f1 = F.coalesce(ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    rated = totals.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    return rated.select(*by, "class", "precision", "recall", "f1", F.col("actual").alias("support"), "tp")


def confusion_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Accuracy, F1 macro, F1 weighted and n, one row (per group)."""
    return class_report(df, label, pred, by, rows).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("n"),
    )


def balance_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class ``n / (k * n_class)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    shape = counts.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))).scalar()
    weight = F.col("shape.total") / (F.col("shape.k") * F.col("n"))
    return counts.withColumn("shape", shape).select(label, "n", weight.alias("weight"))
