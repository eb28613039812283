"""Dense monthly count panel, its features, naive forecasts and temporal folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_index
from ..functions.numeric import clip, cyclic
from ..operators.series import add_lags, add_moving_means, fill_panel

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)
FEATURES = (*[f"lag_{k}" for k in LAGS], *[f"media_{k}" for k in WINDOWS])

# Forecast name -> panel column it repeats.
BASELINES = {
    "baseline_mes_anterior": "lag_1",
    "baseline_media_3m": "media_3",
    "baseline_media_6m": "media_6",
    "baseline_media_12m": "media_12",
    "baseline_sazonal_ano_anterior": "lag_12",
    "baseline_media_historica": "media_historica",
}


def monthly_counts(df: DataFrame, unit: str, date: str, category: str) -> DataFrame:
    """Events per (unit, month, category); partial counts are formed before the shuffle."""
    month = F.trunc(F.col(date).cast("date"), "MM").alias("data")
    return df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit"), month, F.col(category).alias("categoria")).agg(F.count(F.lit(1)).alias("n"))


def monthly_flag_counts(df: DataFrame, unit: str, date: str, flags: Sequence[str]) -> DataFrame:
    """The same from one 0/1 column per category: sum first, melt the small result."""
    month = F.trunc(F.col(date).cast("date"), "MM").alias("data")
    wide = df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit"), month).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in flags])
    return wide.unpivot(["unit", "data"], list(flags), "categoria", "n")


def dense_panel(counts: DataFrame, categories: Sequence[str], months: tuple[Date, Date] | None = None) -> DataFrame:
    """Every (unit, month, category) with its count, 0 where nothing happened.

    Units and the month range are those of all events, listed category or not.

    ``counts`` comes from :func:`monthly_counts`. The grid is made by exploding a
    month sequence and the category list per unit; zero rows and real counts are
    then summed together, so filling takes no join and one shuffle, by series. ``counts`` is kept
    in executor storage because units and month range are read from it as well
    (the event table is scanned once).
    """
    counts = counts.persist()
    if months is None:
        span = counts.agg(F.struct(F.min("data").alias("lo"), F.max("data").alias("hi"))).scalar()
    else:
        span = F.struct(F.lit(months[0]).cast("date").alias("lo"), F.lit(months[1]).cast("date").alias("hi"))
    units = counts.select("unit").distinct().withColumn("span", span)
    grid = (
        units.select("unit", F.explode(F.expr("sequence(span.lo, span.hi, interval 1 month)")).alias("data"))
        .select("unit", "data", F.explode(F.array(*[F.lit(c) for c in categories])).alias("categoria"), F.lit(0).cast("bigint").alias("n"))
    )
    inside = counts.where(F.col("categoria").isin(*categories))
    if months is not None:
        inside = inside.where(F.col("data").between(*months))
    dense = grid.unionByName(inside.select("unit", "data", "categoria", F.col("n").cast("bigint").alias("n")))
    # Distributed by series, so the windows over (unit, categoria) that follow need no further shuffle.
    return (
        dense.repartition("unit", "categoria").groupBy("unit", "data", "categoria").agg(F.sum("n").alias("y"))
        .withColumns({"ano": F.year("data"), "mes": F.month("data")})
    )


def add_unit_year_features(panel: DataFrame, features: DataFrame, cols: Sequence[str], mode: str = "parity") -> DataFrame:
    """Join (unit, ano) features and fill the gaps (see :func:`fill_panel`)."""
    joined = panel.join(features.select("unit", "ano", *cols), ["unit", "ano"], "left")
    return fill_panel(joined, "unit", "categoria", "data", list(cols), mode)


def temporal_features(panel: DataFrame) -> DataFrame:
    """Lags, moving means and history per series: one shuffle and one sort for all."""
    lagged = add_lags(panel, ["unit", "categoria"], "data", "y", LAGS)
    return add_moving_means(lagged, ["unit", "categoria"], "data", "y", WINDOWS)


def naive_baselines(panel: DataFrame) -> DataFrame:
    """Six forecasts: gaps take the historical mean, then 0; never negative."""
    filled = {name: clip(F.coalesce(F.col(src), F.col("media_historica"), F.lit(0.0)).cast("double"), lo=0.0) for name, src in BASELINES.items()}
    return panel.withColumns(filled)


def model_features(panel: DataFrame, harmonics: Sequence[int] = (1, 2)) -> DataFrame:
    """Rows with a full history, plus log1p, cyclic month and time index columns.

    The index counts from the first year of the panel before short-history rows go.
    """
    first_year = panel.agg(F.min(F.year("data"))).scalar()
    out = panel.withColumn("tempo", (F.year("data") - first_year) * 12 + F.month("data"))
    out = out.dropna(subset=list(FEATURES))
    cols: dict[str, Column] = {f"log1p_{c}": F.log1p(F.col(c).cast("double")) for c in FEATURES}
    for k in harmonics:
        cols[f"mes_sin_{k}"], cols[f"mes_cos_{k}"] = cyclic(F.month("data"), k)
    return out.withColumns(cols)


def feature_table(features: DataFrame) -> DataFrame:
    """The model feature table of the target schema (keys, y, 23 features)."""
    double = lambda c: F.col(c).cast("double").alias(c)
    return features.select(
        F.sha2(F.col("unit").cast("string"), 256).alias("bairro_id"), F.sha2("categoria", 256).alias("categoria_id"),
        F.col("data").alias("periodo_mes"), F.col("ano").cast("smallint").alias("ano"), F.col("mes").cast("smallint").alias("mes"),
        F.col("tempo").cast("int").alias("tempo"), F.col("y").cast("int").alias("y"),
        *[double(c) for c in FEATURES], *[double(f"log1p_{c}") for c in FEATURES],
        F.col("IQV").cast("double").alias("iqv"), double("log_pop"),
        *[double(f"mes_{f}_{k}") for k in (1, 2) for f in ("sin", "cos")],
    )


@dataclass(frozen=True)
class TemporalFolds:
    """Expanding-window folds: train before the start, validate ``window`` months from it.

    Fold ``i`` (from 1) starts ``(i - 1) * step`` months after ``start``; the last start
    is not after ``end``.
    """

    start: Date
    end: Date
    window: int = 1
    step: int = 1

    @property
    def count(self) -> int:
        months = (self.end.year - self.start.year) * 12 + self.end.month - self.start.month
        return max(0, months // self.step + 1)

    def start_of(self, fold: int) -> Date:
        months = self.start.year * 12 + self.start.month - 1 + (fold - 1) * self.step
        return Date(months // 12, months % 12 + 1, 1)

    def end_of(self, fold: int) -> Date:
        months = self.start.year * 12 + self.start.month - 1 + (fold - 1) * self.step + self.window
        return Date(months // 12, months % 12 + 1, 1)

    def train(self, df: DataFrame, fold: int, date: str = "data") -> DataFrame:
        return df.where(F.col(date) < F.lit(self.start_of(fold)))

    def validation(self, df: DataFrame, fold: int, date: str = "data") -> DataFrame:
        return df.where((F.col(date) >= F.lit(self.start_of(fold))) & (F.col(date) < F.lit(self.end_of(fold))))


def assign_folds(df: DataFrame, folds: TemporalFolds, date: str = "data") -> DataFrame:
    """Each row once per fold that validates on it.

    The range join rows x folds is arithmetic on the month offset: with offset m,
    fold starts s = 0, step, 2*step... match when s <= m < s + window.
    """
    offset = month_index(F.col(date)) - F.lit(folds.start.year * 12 + folds.start.month)
    first = F.greatest(F.ceil((offset - folds.window + 1) / folds.step), F.lit(0)).cast("int")
    last = F.least(F.floor(offset / folds.step), F.lit(folds.count - 1)).cast("int")
    hits = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    out = df.where(offset >= 0).withColumn("fold", F.explode(F.transform(hits, lambda s: s + 1)))
    return out.withColumn("fold_start", F.add_months(F.lit(folds.start), (F.col("fold") - 1) * folds.step))
