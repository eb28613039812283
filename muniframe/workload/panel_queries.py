"""Dense panel, lags, fills, naive forecasts, folds and forecast metrics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import gain_table
from ..operators.ordering import top_k
from ..operators.series import fill_panel
from ..plans.metrics import best_per_group, fold_metrics, forecast_metrics, monthly_totals, summarize_folds
from ..plans.panel import (
    BASELINES, FEATURES, LAGS, WINDOWS, TemporalFolds, assign_folds, dense_panel, feature_table, monthly_flag_counts,
)
from .adapters import (
    BASELINES_SQL, CATEGORIES, FOLDS, HISTORY_SQL, INCIDENTS_SQL, LONG_SQL, METRIC_COLUMNS_SQL, METRIC_SHIFT, METRICS_SQL, PANEL_SQL, baselines, features,
    history, incidents, panel, unit_year_features,
)
from .catalog import Tables, iso, query, round_all, rounded

KEYS_SQL = "CAST(unit AS BIGINT) AS unit, strftime(data, '%Y-%m-%d') AS data, categoria"


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"unit": F.col("unit").cast("bigint"), "data": iso("data")})


@query(f"WITH {PANEL_SQL} SELECT {KEYS_SQL}, y, CAST(year(data) AS BIGINT) AS ano, CAST(month(data) AS BIGINT) AS mes FROM panel", "dense_panel")
def dense_panel_query(t: Tables) -> DataFrame:
    return _keys(panel(t).withColumns({c: F.col(c).cast("bigint") for c in ("ano", "mes")}))


@query(f"WITH {PANEL_SQL} SELECT {KEYS_SQL}, y FROM panel")
def dense_panel_from_flags(t: Tables) -> DataFrame:
    flagged = incidents(t).select("unit", "o_orderdate", *[(F.col("o_orderpriority") == c).cast("int").alias(c) for c in CATEGORIES])
    counts = monthly_flag_counts(flagged, "unit", "o_orderdate", CATEGORIES)
    return _keys(dense_panel(counts, CATEGORIES).select("unit", "data", "categoria", "y"))


@query(f"WITH {HISTORY_SQL} SELECT {KEYS_SQL}, y, {', '.join(f'CAST(lag_{k} AS BIGINT) AS lag_{k}' for k in LAGS)} FROM hist")
def panel_lags(t: Tables) -> DataFrame:
    return _keys(history(t).select("unit", "data", "categoria", "y", *[f"lag_{k}" for k in LAGS]))


_MEANS = [*[f"media_{k}" for k in WINDOWS], "media_historica"]


@query(f"WITH {HISTORY_SQL} SELECT {KEYS_SQL}, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM hist")
def panel_moving_means(t: Tables) -> DataFrame:
    return round_all(_keys(history(t).select("unit", "data", "categoria", *_MEANS)), _MEANS)


_GAPS_SQL = PANEL_SQL + """,
f AS (SELECT unit, ano, avg(o_totalprice / 10000) AS iqv, ln(1 + count(*)) AS lp FROM inc GROUP BY unit, ano),
g AS (SELECT p.*, CASE WHEN f.ano <> 1997 AND p.unit <> 3 THEN f.iqv END AS iqv, CASE WHEN f.ano <> 1997 AND p.unit <> 3 THEN f.lp END AS lp
  FROM panel p LEFT JOIN f ON f.unit = p.unit AND f.ano = year(p.data))"""


def _fill_sql(part: str, order: str) -> str:
    last = f"last_value({{c}} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return last


def _gaps(t: Tables) -> DataFrame:
    return panel(t).join(unit_year_features(t), ["unit", "ano"], "left")


@query(f"""WITH {_GAPS_SQL},
h AS (SELECT *, {_fill_sql('unit', 'categoria, data').format(c='iqv')} AS iqv2, {_fill_sql('unit', 'categoria, data').format(c='lp')} AS lp2 FROM g),
k AS (SELECT *, first_value(iqv2 IGNORE NULLS) OVER (ORDER BY unit, categoria, data ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS iqv3,
  first_value(lp2 IGNORE NULLS) OVER (ORDER BY unit, categoria, data ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lp3 FROM h)
SELECT {KEYS_SQL}, round(iqv3, 6) AS "IQV", round(lp3, 6) AS log_pop FROM k""")
def panel_fill(t: Tables) -> DataFrame:
    out = fill_panel(_gaps(t), "unit", "categoria", "data", ["IQV", "log_pop"])
    return round_all(_keys(out.select("unit", "data", "categoria", "IQV", "log_pop")), ["IQV", "log_pop"])


@query(f"""WITH {_GAPS_SQL},
h AS (SELECT *, {_fill_sql('unit, categoria', 'data').format(c='iqv')} AS iqv2 FROM g),
k AS (SELECT *, first_value(iqv2 IGNORE NULLS) OVER (PARTITION BY unit, categoria ORDER BY data ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS iqv3 FROM h)
SELECT {KEYS_SQL}, round(iqv3, 6) AS "IQV" FROM k""")
def panel_fill_time(t: Tables) -> DataFrame:
    out = fill_panel(_gaps(t), "unit", "categoria", "data", ["IQV"], mode="time")
    return round_all(_keys(out.select("unit", "data", "categoria", "IQV")), ["IQV"])


_CYCLES = [f"mes_{f}_{k}" for k in (1, 2) for f in ("sin", "cos")]
_FULL_HISTORY = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


@query(f"""WITH {HISTORY_SQL}
SELECT {KEYS_SQL}, CAST((year(data) - (SELECT min(year(data)) FROM panel)) * 12 + month(data) AS BIGINT) AS tempo,
  {', '.join(f'round({f}(2 * pi() * {k} * month(data) / 12) + 1e-9, 6) AS mes_{f}_{k}' for k in (1, 2) for f in ('sin', 'cos'))},
  {', '.join(f'round(ln(1 + {c}), 6) AS log1p_{c}' for c in FEATURES)} FROM hist WHERE {_FULL_HISTORY}""")
def cyclic_time_features(t: Tables) -> DataFrame:
    logs = [f"log1p_{c}" for c in FEATURES]
    out = features(t).select("unit", "data", "categoria", F.col("tempo").cast("bigint"), *_CYCLES, *logs)
    # The shift keeps a sine of about -1e-16 from becoming a negative zero in one engine only.
    return round_all(_keys(out).withColumns({c: F.col(c) + 1e-9 for c in _CYCLES}), [*_CYCLES, *logs])


_SUMS_SQL = ", ".join(
    [f"round(sum(CAST({c} AS DOUBLE)) + 1e-6, 3) AS {c}, round(sum(ln(1 + CAST({c} AS DOUBLE))) + 1e-6, 3) AS log1p_{c}" for c in FEATURES]
    + [f"round(sum({f}(2 * pi() * {k} * month(data) / 12)) + 1e-6, 3) AS mes_{f}_{k}" for k in (1, 2) for f in ("sin", "cos")]
)


@query(f"""WITH {HISTORY_SQL}
SELECT CAST(year(data) AS BIGINT) AS ano, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y, {_SUMS_SQL},
  CAST(sum((year(data) - (SELECT min(year(data)) FROM panel)) * 12 + month(data)) AS BIGINT) AS tempo,
  CAST(count(DISTINCT CAST(unit AS VARCHAR) || categoria) AS BIGINT) AS series FROM hist WHERE lag_12 IS NOT NULL GROUP BY 1""")
def feature_table_summary(t: Tables) -> DataFrame:
    """Every column of the feature table that comes from the panel, summed by year."""
    table = feature_table(features(t))
    cyclic = [f"mes_{f}_{k}" for k in (1, 2) for f in ("sin", "cos")]
    summed = [*FEATURES, *[f"log1p_{c}" for c in FEATURES], *cyclic]
    return table.groupBy(F.col("ano").cast("bigint").alias("ano")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[rounded(F.sum(c) + F.lit(1e-6), 3).alias(c) for c in summed], F.sum("tempo").alias("tempo"),
        F.count_distinct("bairro_id", "categoria_id").alias("series"),
    )


@query(f"WITH {BASELINES_SQL} SELECT {KEYS_SQL}, y, {', '.join(f'round({c}, 6) AS {c}' for c in BASELINES)} FROM base", "naive_baselines")
def naive_baselines_query(t: Tables) -> DataFrame:
    return round_all(_keys(baselines(t).select("unit", "data", "categoria", "y", *BASELINES)), list(BASELINES))


_FOLD_SQL = LONG_SQL + f",\nfm AS (SELECT fold, modelo, {METRICS_SQL} FROM folded GROUP BY fold, modelo)"
_FOLD_CAT_SQL = LONG_SQL + f",\nfm AS (SELECT fold, categoria, modelo, {METRICS_SQL} FROM folded GROUP BY fold, categoria, modelo)"
_SUMMARY_AGG = "avg(mae) AS mae, avg(rmse) AS rmse, avg(wape) AS wape, avg(bias) AS bias, sum(total_real) AS total_real, sum(total_previsto) AS total_previsto"


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: rounded(F.col(m) + shift, digits) for m, (shift, digits) in METRIC_SHIFT.items()})


def _fold_metrics(t: Tables, by: tuple[str, ...] = ()) -> DataFrame:
    return fold_metrics(baselines(t), FOLDS, "y", list(BASELINES), by)


@query(f"WITH {_FOLD_SQL} SELECT CAST(fold AS BIGINT) AS fold, strftime(DATE '1998-12-01' + to_months(CAST(fold AS INTEGER)), '%Y-%m-%d') AS fold_start, modelo, {METRIC_COLUMNS_SQL} FROM fm", "fold_metrics")
def fold_metrics_query(t: Tables) -> DataFrame:
    out = _fold_metrics(t).withColumns({"fold": F.col("fold").cast("bigint"), "fold_start": iso("fold_start")})
    return _round_metrics(out)


@query(f"WITH {_FOLD_SQL}, s AS (SELECT modelo, {_SUMMARY_AGG} FROM fm GROUP BY modelo) SELECT modelo, {METRIC_COLUMNS_SQL} FROM s")
def baseline_summary(t: Tables) -> DataFrame:
    return _round_metrics(summarize_folds(_fold_metrics(t), ["modelo"]))


_CATEGORY_SUMMARY_SQL = _FOLD_CAT_SQL + f",\ns AS (SELECT categoria, modelo, {_SUMMARY_AGG} FROM fm GROUP BY categoria, modelo)"


def _category_summary(t: Tables) -> DataFrame:
    return summarize_folds(_fold_metrics(t, ("categoria",)), ["categoria", "modelo"])


@query(f"WITH {_CATEGORY_SUMMARY_SQL} SELECT categoria, modelo, {METRIC_COLUMNS_SQL} FROM s")
def category_summary(t: Tables) -> DataFrame:
    return _round_metrics(_category_summary(t))


@query(f"WITH {_CATEGORY_SUMMARY_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY wape, modelo) AS k FROM s) SELECT categoria, modelo, {METRIC_COLUMNS_SQL} FROM b WHERE k = 1")
def best_per_category(t: Tables) -> DataFrame:
    return _round_metrics(best_per_group(_category_summary(t), ["categoria"], "WAPE", "modelo"))


@query(f"""WITH {_CATEGORY_SUMMARY_SQL}
SELECT a.categoria, round(a.wape, 6) AS "WAPE_a", round(b.wape, 6) AS "WAPE_b", round(b.wape - a.wape, 6) AS "gain_WAPE_abs", round((b.wape - a.wape) / nullif(b.wape, 0), 6) AS "gain_WAPE_pct",
  round(b.mae - a.mae, 6) AS "gain_MAE_abs" FROM s a JOIN s b ON a.categoria = b.categoria AND a.modelo = 'baseline_media_6m' AND b.modelo = 'baseline_mes_anterior'""", "gain_table")
def gain_table_query(t: Tables) -> DataFrame:
    summary = _category_summary(t).persist()
    a, b = (summary.where(F.col("modelo") == m).drop("modelo") for m in ("baseline_media_6m", "baseline_mes_anterior"))
    fields = ["WAPE_a", "WAPE_b", "gain_WAPE_abs", "gain_WAPE_pct", "gain_MAE_abs"]
    return round_all(gain_table(a, b, ["categoria"], ("_a", "_b"), ["WAPE", "MAE"]).select("categoria", *fields), fields)


_POOLED_SQL = LONG_SQL + ",\np AS (SELECT * FROM folded WHERE modelo = 'baseline_media_6m')"


@query(f"""WITH {_POOLED_SQL}, m AS (SELECT unit, categoria, {METRICS_SQL} FROM p GROUP BY unit, categoria)
SELECT CAST(unit AS BIGINT) AS unit, categoria, {METRIC_COLUMNS_SQL} FROM m""", "forecast_metrics")
def forecast_metrics_query(t: Tables) -> DataFrame:
    validated = assign_folds(baselines(t), FOLDS)
    out = forecast_metrics(validated, "y", "baseline_media_6m", ["unit", "categoria"])
    return _round_metrics(out).withColumn("unit", F.col("unit").cast("bigint"))


@query(f"""WITH {_POOLED_SQL}, m AS (SELECT unit, {METRICS_SQL} FROM p GROUP BY unit)
SELECT * FROM (SELECT 'best' AS side, CAST(unit AS BIGINT) AS unit, round(wape, 6) AS "WAPE" FROM m ORDER BY wape, unit LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'worst', CAST(unit AS BIGINT), round(wape, 6) FROM m ORDER BY wape DESC, unit LIMIT 4)""")
def top_bottom_units(t: Tables) -> DataFrame:
    by_unit = forecast_metrics(assign_folds(baselines(t), FOLDS), "y", "baseline_media_6m", ["unit"])
    best = top_k(by_unit, [F.col("WAPE").asc(), F.col("unit").asc()], 4).withColumn("side", F.lit("best"))
    worst = top_k(by_unit, [F.col("WAPE").desc(), F.col("unit").asc()], 4).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("side", F.col("unit").cast("bigint"), rounded("WAPE").alias("WAPE"))


@query(f"""WITH {_POOLED_SQL} SELECT strftime(data, '%Y-%m-%d') AS data, categoria, CAST(sum(y) AS BIGINT) AS total_real, round(sum(y_pred), 4) AS total_previsto FROM p GROUP BY 1, 2""")
def actual_vs_predicted_series(t: Tables) -> DataFrame:
    out = monthly_totals(assign_folds(baselines(t), FOLDS), "y", "baseline_media_6m", ["categoria"])
    return out.select(iso("data").alias("data"), "categoria", "total_real", rounded("total_previsto", 4).alias("total_previsto"))


@query(f"""WITH {PANEL_SQL}, f AS (SELECT i AS fold, CAST(DATE '1999-01-01' + to_months(CAST(4 * (i - 1) AS INTEGER)) AS DATE) AS s FROM generate_series(1, 8) g(i))
SELECT CAST(fold AS BIGINT) AS fold, strftime(s, '%Y-%m-%d') AS fold_start, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS y
FROM panel JOIN f ON data >= s AND data < s + INTERVAL 6 MONTH GROUP BY 1, 2""")
def overlapping_folds(t: Tables) -> DataFrame:
    folds = TemporalFolds(FOLDS.start, FOLDS.end, window=6, step=4)
    tagged = assign_folds(panel(t), folds)
    return tagged.groupBy(F.col("fold").cast("bigint").alias("fold"), iso("fold_start").alias("fold_start")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


@query(f"""WITH {INCIDENTS_SQL} SELECT strftime(data, '%Y-%m-%d') AS data, categoria, CAST(count(*) AS BIGINT) AS n FROM inc GROUP BY 1, 2""")
def monthly_category_counts(t: Tables) -> DataFrame:
    return panel(t).groupBy(iso("data").alias("data"), "categoria").agg(F.sum("y").alias("n")).where("n > 0")
