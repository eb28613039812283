"""Driver tables seen as incidents, units, categories and census extracts.

One order is one incident, its customer's nation the unit (25), its priority the
category, its date the incident date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..plans.panel import (
    TemporalFolds, add_unit_year_features, dense_panel, model_features, monthly_counts, naive_baselines, temporal_features,
)
from .catalog import Tables

CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FOLDS = TemporalFolds(date(1999, 1, 1), date(2001, 8, 1))
YEAR_FOLDS = TemporalFolds(date(2000, 1, 1), date(2001, 8, 1), window=12, step=12)


def incidents(t: Tables) -> DataFrame:
    """Orders with the nation of their customer."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("unit"), "c_mktsegment")
    return t.orders.join(customers, "o_custkey")


def panel(t: Tables) -> DataFrame:
    return dense_panel(monthly_counts(incidents(t), "unit", "o_orderdate", "o_orderpriority"), CATEGORIES)


def history(t: Tables) -> DataFrame:
    return temporal_features(panel(t))


def baselines(t: Tables) -> DataFrame:
    return naive_baselines(history(t))


def unit_year_features(t: Tables) -> DataFrame:
    """Stand-ins for the yearly index and population: missing in 1997 and for unit 3."""
    yearly = incidents(t).withColumn("ano", F.year("o_orderdate")).groupBy("unit", "ano").agg(
        F.avg(F.col("o_totalprice") / 10000).alias("IQV"), F.log1p(F.count(F.lit(1)).cast("double")).alias("log_pop")
    )
    missing = (F.col("ano") == 1997) | (F.col("unit") == 3)
    return yearly.withColumns({c: F.when(~missing, F.col(c)) for c in ("IQV", "log_pop")})


def features(t: Tables) -> DataFrame:
    """The model feature frame: history, unit-year features filled, logs, cyclic month, time index."""
    filled = add_unit_year_features(panel(t), unit_year_features(t), ["IQV", "log_pop"])
    return model_features(temporal_features(filled))


def unit_year(t: Tables) -> DataFrame:
    """One row per (unit, year): six indicators, population and category counts.

    Kept in executor storage: normalisation reads it twice, the order table only once.
    """
    inc = incidents(t).withColumn("ano", F.year("o_orderdate"))
    flags = {name: F.sum((F.col("o_orderpriority") == p).cast("int")).cast("double") for name, p in zip(("urgent", "high", "medium"), CATEGORIES)}
    return inc.groupBy("unit", "ano").agg(
        F.avg("o_totalprice").alias("price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished"),
        F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("pending"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgency"),
        F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("building"),
        F.stddev_samp("o_totalprice").alias("spread"),
        F.count_distinct("o_custkey").alias("population"),
        *[c.alias(n) for n, c in flags.items()],
    ).persist()


UP, DOWN = ("price", "finished"), ("pending", "urgency", "building", "spread")

# --- SQL building blocks -------------------------------------------------------------
INCIDENTS_SQL = """inc AS (
  SELECT c_nationkey AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS data, o_orderpriority AS categoria,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, c_mktsegment, CAST(year(o_orderdate) AS BIGINT) AS ano
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

PANEL_SQL = INCIDENTS_SQL + """,
counts AS (SELECT unit, data, categoria, count(*) AS n FROM inc GROUP BY unit, data, categoria),
months AS (SELECT CAST(unnest(generate_series((SELECT min(data) FROM counts), (SELECT max(data) FROM counts), INTERVAL 1 MONTH)) AS DATE) AS data),
panel AS (
  SELECT u.unit, m.data, k.categoria, CAST(coalesce(c.n, 0) AS BIGINT) AS y
  FROM (SELECT DISTINCT unit FROM counts) u CROSS JOIN months m CROSS JOIN (SELECT DISTINCT categoria FROM counts) k
  LEFT JOIN counts c ON c.unit = u.unit AND c.data = m.data AND c.categoria = k.categoria)"""


def _over(frame: str = "") -> str:
    return f"OVER (PARTITION BY unit, categoria ORDER BY data {frame})"


HISTORY_SQL = PANEL_SQL + ",\nhist AS (SELECT *, " + ", ".join(
    [f"lag(y, {k}) {_over()} AS lag_{k}" for k in (1, 2, 3, 6, 12)]
    + [f"avg(y) {_over(f'ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING')} AS media_{k}" for k in (3, 6, 12)]
    + [f"avg(y) {_over('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS media_historica"]
) + " FROM panel)"

BASELINE_SOURCES = {
    "baseline_mes_anterior": "lag_1", "baseline_media_3m": "media_3", "baseline_media_6m": "media_6", "baseline_media_12m": "media_12",
    "baseline_sazonal_ano_anterior": "lag_12", "baseline_media_historica": "media_historica",
}
BASELINES_SQL = HISTORY_SQL + ",\nbase AS (SELECT unit, data, categoria, y, " + ", ".join(
    f"CAST(coalesce({s}, media_historica, 0) AS DOUBLE) AS {n}" for n, s in BASELINE_SOURCES.items()
) + " FROM hist)"

LONG_SQL = BASELINES_SQL + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT unit, data, categoria, y, '{n}' AS modelo, {n} AS y_pred FROM base WHERE data >= DATE '1999-01-01'" for n in BASELINE_SOURCES
) + "),\nfolded AS (SELECT *, CAST((year(data) - 1999) * 12 + month(data) AS BIGINT) AS fold FROM long)"

METRICS_SQL = """avg(abs(y_pred - y)) AS mae, sqrt(avg((y_pred - y) * (y_pred - y))) AS rmse,
  sum(abs(y_pred - y)) / nullif(sum(CAST(y AS DOUBLE)), 0) AS wape, sum(y_pred - y) / nullif(sum(CAST(y AS DOUBLE)), 0) AS bias,
  sum(CAST(y AS DOUBLE)) AS total_real, sum(y_pred) AS total_previsto"""

# Averages of twelfths often end in an exact decimal tie. Both engines shift by less than
# the last digit before rounding, so that a tie does not depend on the order of additions.
METRIC_SHIFT = {"MAE": (1e-7, 6), "RMSE": (1e-7, 6), "WAPE": (1e-7, 6), "BIAS": (1e-7, 6), "TOTAL_REAL": (1e-5, 4), "TOTAL_PREVISTO": (1e-5, 4)}
METRIC_COLUMNS_SQL = ", ".join(f'round({m.lower()} + {shift}, {digits}) AS "{m}"' for m, (shift, digits) in METRIC_SHIFT.items())

UNIT_YEAR_SQL = INCIDENTS_SQL + """,
uy AS (SELECT unit, ano, avg(o_totalprice) AS price,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS finished, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS pending,
  avg(CASE WHEN categoria = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgency, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS building,
  stddev_samp(o_totalprice) AS spread, count(DISTINCT o_custkey) AS population,
  CAST(sum(CASE WHEN categoria = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS urgent,
  CAST(sum(CASE WHEN categoria = '2-HIGH' THEN 1 ELSE 0 END) AS DOUBLE) AS high,
  CAST(sum(CASE WHEN categoria = '3-MEDIUM' THEN 1 ELSE 0 END) AS DOUBLE) AS medium
  FROM inc GROUP BY unit, ano)"""

NORMS_SQL = UNIT_YEAR_SQL + ",\nb AS (SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in UP + DOWN) + " FROM uy),\nnorm AS (SELECT uy.*, " + ", ".join(
    [f"CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c} - {c}_lo) / ({c}_hi - {c}_lo) END AS {c}_norm" for c in UP]
    + [f"CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c}_hi - {c}) / ({c}_hi - {c}_lo) END AS {c}_norm" for c in DOWN]
) + " FROM uy CROSS JOIN b)"
NORMS = [c + "_norm" for c in UP + DOWN]
IQV_SQL = NORMS_SQL + f""",
iqv AS (SELECT *, 100 * ({' + '.join(f'coalesce({c}, 0)' for c in NORMS)}) / nullif({' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in NORMS)}, 0) AS "IQV",
  100 * (price_norm / 3 + finished_norm / 3 + (pending_norm + urgency_norm + building_norm + spread_norm) / 12) AS "IQV_final" FROM norm)"""
