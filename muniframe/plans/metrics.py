"""Forecast metrics, pooled and per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from ..operators.ordering import first_per_group
from .panel import TemporalFolds, assign_folds

METRICS = ("MAE", "RMSE", "WAPE", "BIAS", "TOTAL_REAL", "TOTAL_PREVISTO")


def metric_columns(y: str, yhat: str) -> dict[str, Column]:
    """Aggregates over rows where both sides are known; WAPE and BIAS are null for a zero total."""
    actual, predicted = F.col(y).cast("double"), F.nanvl(F.col(yhat).cast("double"), F.lit(None).cast("double"))
    error = predicted - actual
    known = error.isNotNull()
    total = F.sum(F.when(known, actual))
    return {
        "MAE": F.avg(F.abs(error)),
        "RMSE": F.sqrt(F.avg(error * error)),
        "WAPE": ratio(F.sum(F.abs(error)), total),
        "BIAS": ratio(F.sum(error), total),
        "TOTAL_REAL": total,
        "TOTAL_PREVISTO": F.sum(F.when(known, predicted)),
    }


def forecast_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """One row of metrics per group, in one aggregate."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns(y, yhat).items()])


def fold_metrics(df: DataFrame, folds: TemporalFolds, y: str, preds: Sequence[str], by: Sequence[str] = (), name: str = "modelo", date: str = "data") -> DataFrame:
    """Metrics of several forecasts per fold (and group).

    All forecasts are aggregated side by side in one pass and turned into rows
    afterwards, instead of multiplying the input by the number of forecasts.
    """
    tagged = assign_folds(df, folds, date)
    aggs = [c.alias(f"{p}__{m}") for p in preds for m, c in metric_columns(y, p).items()]
    wide = tagged.groupBy("fold", "fold_start", *by).agg(*aggs)
    rows = [F.struct(F.lit(p).alias(name), *[F.col(f"{p}__{m}").alias(m) for m in METRICS]) for p in preds]
    return wide.select("fold", "fold_start", *by, F.inline(F.array(*rows)))


def summarize_folds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the rates and sum of the totals over folds; undefined WAPE is skipped."""
    return df.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in METRICS[:4]], *[F.sum(m).alias(m) for m in METRICS[4:]]
    )


def best_per_group(df: DataFrame, group: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Lowest metric per group, ties by name, undefined metric last."""
    return first_per_group(df, group, [F.coalesce(F.col(metric), F.lit(float("inf"))), F.col(tie)])


def monthly_totals(df: DataFrame, y: str, yhat: str, by: Sequence[str], date: str = "data") -> DataFrame:
    """Actual and predicted totals per month and group (chart series)."""
    return df.groupBy(date, *by).agg(F.sum(y).alias("total_real"), F.sum(yhat).alias("total_previsto"))
