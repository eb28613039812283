"""Interpolation, composite index, classes, rates and regressions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import histogram, mean_by, two_level_mean
from ..operators.ordering import exact_quantiles
from ..plans.index import composite_index, normalize, quantile_class, ranking, weight_grid, weight_scores, weight_sensitivity
from ..plans.indicators import ConsistencyColumns, apply_consistency, attach_yearly, interpolate_years
from ..plans.stats import effect_intercepts, ols_by, ols_fixed_effects, regression_line, unit_year_rates
from .adapters import DOWN, INCIDENTS_SQL, IQV_SQL, NORMS, UNIT_YEAR_SQL, UP, incidents, unit_year
from .catalog import Tables, query, round_all, rounded

LO, HI, Y0, Y1 = 1995, 2001, 1996, 2000
ANCHORS = ("populacao", "resp", "renda", "pop_15", "alf", "homes", "banheiro", "esgoto", "agua", "lixo")
NAMES = ConsistencyColumns(
    population="pop_15", literate="alf", illiterate="analf", literacy_rate="pct_alf", illiteracy_rate="pct_analf", households="homes",
    lacking=("banheiro", "esgoto", "agua", "lixo"), whole=("populacao", "resp"), two_decimals=("renda",),
)


def _anchors(t: Tables) -> DataFrame:
    """Ten indicators per nation in two anchor years, side by side. Unit 7 lacks sewage data."""
    inc = incidents(t).withColumn("ano", F.year("o_orderdate")).where(F.col("ano").isin(Y0, Y1))
    flag = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    cols = {
        "populacao": F.count(F.lit(1)).cast("double"), "resp": F.count_distinct("o_custkey").cast("double"), "renda": F.avg("o_totalprice") / 10000,
        "pop_15": flag(s != "O"), "alf": flag(s == "F"), "homes": flag(p <= "2-HIGH"), "banheiro": flag(p == "5-LOW"),
        "esgoto": flag((p == "4-NOT SPECIFIED") & (F.col("unit") != 7)), "agua": flag(p == "3-MEDIUM") * 3, "lixo": flag((p == "1-URGENT") & (s == "F")),
    }
    wide = inc.groupBy("unit").pivot("ano", [Y0, Y1]).agg(*[c.alias(n) for n, c in cols.items()])
    wide = wide.withColumnsRenamed({f"{y}_{n}": f"{n}_{y}" for y in (Y0, Y1) for n in cols})
    wide = wide.withColumn(f"esgoto_{Y0}", F.when(F.col("unit") != 7, F.col(f"esgoto_{Y0}")))
    return wide.withColumn("last_rate", F.col(f"alf_{Y1}") / F.nullif(F.col(f"pop_15_{Y1}"), F.lit(0.0)) * 100)


def _yearly(t: Tables) -> DataFrame:
    return interpolate_years(_anchors(t), "unit", ANCHORS, Y0, Y1, LO, HI, carry=["last_rate"])


_ANCHOR_AGG = """count(*) AS populacao, count(DISTINCT o_custkey) AS resp, avg(o_totalprice) / 10000 AS renda,
  sum(CASE WHEN o_orderstatus <> 'O' THEN 1.0 ELSE 0.0 END) AS pop_15, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS alf,
  sum(CASE WHEN categoria <= '2-HIGH' THEN 1.0 ELSE 0.0 END) AS homes, sum(CASE WHEN categoria = '5-LOW' THEN 1.0 ELSE 0.0 END) AS banheiro,
  sum(CASE WHEN categoria = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END) AS esgoto, 3 * sum(CASE WHEN categoria = '3-MEDIUM' THEN 1.0 ELSE 0.0 END) AS agua,
  sum(CASE WHEN categoria = '1-URGENT' AND o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS lixo"""
YEARLY_SQL = INCIDENTS_SQL + f""",
anchor AS (SELECT unit, ano, {_ANCHOR_AGG} FROM inc WHERE ano IN ({Y0}, {Y1}) GROUP BY unit, ano),
wide AS (SELECT a.unit, {', '.join(f"CAST({'CASE WHEN a.unit <> 7 THEN a.esgoto END' if v == 'esgoto' else 'a.' + v} AS DOUBLE) AS {v}_a, CAST(b.{v} AS DOUBLE) AS {v}_b" for v in ANCHORS)}
  FROM (SELECT * FROM anchor WHERE ano = {Y0}) a JOIN (SELECT * FROM anchor WHERE ano = {Y1}) b ON a.unit = b.unit),
yearly AS (SELECT CAST(unit AS BIGINT) AS unit, CAST(y AS BIGINT) AS ano,
  CASE WHEN y IN ({Y0}, {Y1}) THEN 'observado' WHEN y BETWEEN {Y0} AND {Y1} THEN 'interpolado' ELSE 'extrapolado' END AS tipo_estimativa,
  {', '.join(f"({v}_b - {v}_a) / {Y1 - Y0}.0 * (y - {Y0}) + {v}_a AS {v}" for v in ANCHORS)}, alf_b / nullif(pop_15_b, 0) * 100 AS last_rate
  FROM wide CROSS JOIN generate_series({LO}, {HI}) g(y))"""


@query(f"WITH {YEARLY_SQL} SELECT unit, ano, tipo_estimativa, {', '.join(f'round({v}, 6) AS {v}_estimado' for v in ANCHORS)} FROM yearly")
def linear_interpolate(t: Tables) -> DataFrame:
    est = [f"{v}_estimado" for v in ANCHORS]
    return round_all(_yearly(t).drop("last_rate"), est).withColumns({c: F.col(c).cast("bigint") for c in ("unit", "ano")})


def _even(x: str, digits: int) -> str:
    return f"round_even({x}, {digits})"


_LACK = NAMES.lacking
CONSISTENT_SQL = YEARLY_SQL + f""",
s1 AS (SELECT *, CASE WHEN ano > 2000 THEN last_rate ELSE alf / nullif(pop_15, 0) * 100 END AS rate0 FROM yearly),
s2 AS (SELECT *, CASE WHEN rate0 < 0 THEN 0 WHEN rate0 > 100 THEN 100 ELSE rate0 END AS rate FROM s1),
s3 AS (SELECT *, pop_15 * rate / 100 AS alf2, CASE WHEN homes < 0 THEN 0 ELSE homes END AS homes2,
  {', '.join(f'CASE WHEN {v} < 0 THEN 0 ELSE {v} END AS {v}2' for v in _LACK)} FROM s2),
s4 AS (SELECT *, pop_15 - alf2 AS analf2, {', '.join(f'CASE WHEN {v}2 <= homes2 THEN {v}2 ELSE homes2 END AS {v}3' for v in _LACK)} FROM s3)"""


@query(f"""WITH {CONSISTENT_SQL}
SELECT unit, ano, tipo_estimativa, CAST(round_even(populacao, 0) AS BIGINT) AS populacao_estimado, CAST(round_even(resp, 0) AS BIGINT) AS resp_estimado,
  round_even(renda, 2) AS renda_estimado, CAST(round_even(pop_15, 0) AS BIGINT) AS pop_15_estimado, CAST(round_even(alf2, 0) AS BIGINT) AS alf_estimado,
  CAST(round_even(analf2, 0) AS BIGINT) AS analf_estimado, CAST(round_even(homes2, 0) AS BIGINT) AS homes_estimado,
  round_even(CASE WHEN pop_15 > 0 THEN rate END, 2) AS pct_alf_estimado, round_even(CASE WHEN pop_15 > 0 THEN analf2 / pop_15 * 100 END, 2) AS pct_analf_estimado,
  {', '.join(f'CAST(round_even({v}3, 0) AS BIGINT) AS {v}_estimado, round_even(CASE WHEN homes2 > 0 THEN {v}3 / homes2 * 100 END, 2) AS pct_{v}_estimado' for v in _LACK)}
FROM s4""")
def consistency_rules(t: Tables) -> DataFrame:
    out = apply_consistency(_yearly(t), "ano", "last_rate", NAMES, last_year=Y1)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("unit", "ano")})


@query(f"""WITH {YEARLY_SQL}
SELECT CAST(i.ano AS BIGINT) AS ano, y.tipo_estimativa, CAST(count(*) AS BIGINT) AS n, round(sum(y.populacao), 4) AS populacao
FROM inc i LEFT JOIN yearly y ON y.unit = i.unit AND y.ano = i.ano GROUP BY 1, 2""")
def attach_yearly_indicators(t: Tables) -> DataFrame:
    yearly = _yearly(t).select("unit", F.col("ano").alias("ano_ind"), "tipo_estimativa", "populacao_estimado")
    inc = incidents(t).select("unit", F.year("o_orderdate").cast("bigint").alias("ano"))
    joined = attach_yearly(inc, yearly, "unit", "ano", "ano_ind")
    return joined.groupBy("ano", "tipo_estimativa").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("populacao_estimado"), 4).alias("populacao"))


def _iqv(t: Tables) -> DataFrame:
    weights = dict(zip(NORMS, (1 / 3, 1 / 3, 1 / 12, 1 / 12, 1 / 12, 1 / 12)))
    scored = normalize(unit_year(t), UP, DOWN)
    return scored.withColumns({"IQV": composite_index(NORMS), "IQV_final": composite_index(NORMS, weights)})


@query(f"""WITH {IQV_SQL} SELECT CAST(unit AS BIGINT) AS unit, CAST(ano AS BIGINT) AS ano, {', '.join(f'round({c}, 6) AS {c}' for c in NORMS)}, round("IQV", 6) AS "IQV" FROM iqv""")
def minmax_index(t: Tables) -> DataFrame:
    out = round_all(_iqv(t).select("unit", "ano", *NORMS, "IQV"), [*NORMS, "IQV"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("unit", "ano")})


@query(f"""WITH {IQV_SQL} SELECT CAST(unit AS BIGINT) AS unit, CAST(ano AS BIGINT) AS ano, round("IQV_final", 6) AS "IQV_final" FROM iqv""")
def index_weighted(t: Tables) -> DataFrame:
    return _iqv(t).select(F.col("unit").cast("bigint"), F.col("ano").cast("bigint"), rounded("IQV_final").alias("IQV_final"))


@query(f"""WITH {IQV_SQL}, m AS (SELECT unit, avg("IQV_final") AS v FROM iqv GROUP BY unit)
SELECT CAST(unit AS BIGINT) AS unit, round(v, 6) AS "IQV_final", CAST(row_number() OVER (ORDER BY v DESC, unit) AS BIGINT) AS ranking FROM m""")
def index_ranking(t: Tables) -> DataFrame:
    return ranking(_iqv(t), "unit", "IQV_final").select(F.col("unit").cast("bigint"), rounded("IQV_final").alias("IQV_final"), "ranking")


_W = "abcdef"
SENSITIVITY_SQL = f"""WITH {IQV_SQL},
u AS (SELECT unit, {', '.join(f'avg({c}) AS {c}' for c in NORMS)} FROM iqv GROUP BY unit),
d AS (SELECT unnest(generate_series(1, 5)) AS v),
w AS (SELECT {', '.join(f'{x}.v * 0.1 AS {x}' for x in _W[:5])}, (10 - a.v - b.v - c.v - d.v - e.v) * 0.1 AS f, a.v * 10000 + b.v * 1000 + c.v * 100 + d.v * 10 + e.v AS id
  FROM d a CROSS JOIN d b CROSS JOIN d c CROSS JOIN d d CROSS JOIN d e WHERE a.v + b.v + c.v + d.v + e.v <= 9),
s AS (SELECT unit, id, round(100 * ({' + '.join(f'CAST({x} AS DOUBLE) * {c}' for x, c in zip(_W, NORMS))}), 9) AS score FROM u CROSS JOIN w),
r AS (SELECT unit, CAST(rank() OVER (PARTITION BY id ORDER BY score DESC) AS DOUBLE) AS rk FROM s),
n AS (SELECT count(*) AS k FROM u)
SELECT CAST(unit AS BIGINT) AS unit, round(avg(rk), 6) AS rank_medio, quantile_cont(rk, 0.5) AS rank_mediano, CAST(min(rk) AS BIGINT) AS melhor_rank,
  CAST(max(rk) AS BIGINT) AS pior_rank, CAST(max(rk) - min(rk) AS BIGINT) AS amplitude_rank, round(stddev_samp(rk), 6) AS desvio_rank,
  round(quantile_cont(rk, 0.05), 6) AS rank_p05, round(quantile_cont(rk, 0.95), 6) AS rank_p95,
  round(avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END), 6) AS freq_top10,
  round(avg(CASE WHEN rk >= (SELECT k FROM n) - 9 THEN 1.0 ELSE 0.0 END), 6) AS freq_bottom10
FROM r GROUP BY unit"""


@query(SENSITIVITY_SQL, "weight_sensitivity")
def weight_sensitivity_summary(t: Tables) -> DataFrame:
    units = mean_by(normalize(unit_year(t), UP, DOWN), ["unit"], NORMS)
    out = weight_sensitivity(units, "unit", NORMS, weight_grid(6, 0.1, 0.1))
    fields = ["rank_medio", "rank_mediano", "desvio_rank", "rank_p05", "rank_p95", "freq_top10", "freq_bottom10"]
    return round_all(out, fields).withColumn("unit", F.col("unit").cast("bigint"))


_WEIGHTS_SQL = SENSITIVITY_SQL[: SENSITIVITY_SQL.index(",\nr AS (")]


@query(f"""{_WEIGHTS_SQL}, k AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS weight_id FROM w)
SELECT weight_id, round(CAST(any_value(w.a) AS DOUBLE), 6) AS w_first, round(CAST(any_value(w.f) AS DOUBLE), 6) AS w_last, CAST(count(*) AS BIGINT) AS n,
  round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM s JOIN k ON k.id = s.id JOIN w ON w.id = s.id GROUP BY weight_id""")
def weight_compositions(t: Tables) -> DataFrame:
    """Every weight vector with the range of scores it gives to the units."""
    units = mean_by(normalize(unit_year(t), UP, DOWN), ["unit"], NORMS)
    grid = weight_grid(6, 0.1, 0.1)
    vectors = F.array(*[F.array(*[F.lit(float(w)) for w in v]) for v in grid])
    scores = weight_scores(units, "unit", NORMS, grid).groupBy("weight_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    vector = F.get(vectors, F.col("weight_id"))
    out = scores.select(F.col("weight_id").cast("bigint"), vector[0].alias("w_first"), vector[5].alias("w_last"), "n", "lowest", "highest")
    return round_all(out, ["w_first", "w_last", "lowest", "highest"])


@query(f"""WITH {IQV_SQL}, u AS (SELECT unit, avg("IQV_final") AS v FROM iqv GROUP BY unit), n AS (SELECT u.unit, CASE WHEN u.unit <> 5 THEN v END AS v FROM u),
q AS (SELECT quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75 FROM n)
SELECT CAST(unit AS BIGINT) AS unit, CASE WHEN v <= p25 THEN 'IQV baixo' WHEN v > p25 AND v < p75 THEN 'IQV médio' WHEN v >= p75 THEN 'IQV alto' ELSE 'Sem dados' END AS classe
FROM n CROSS JOIN q""")
def quartile_class_inclusive(t: Tables) -> DataFrame:
    units = two_level_mean(_iqv(t), "unit", "ano", ["IQV_final"])
    known = units.withColumn("IQV_final", F.when(F.col("unit") != 5, F.col("IQV_final")))
    return quantile_class(known, "IQV_final").select(F.col("unit").cast("bigint"), "classe")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders)
SELECT o_orderpriority, CASE WHEN o_totalprice < p25 THEN 'Baixo IQV' WHEN o_totalprice > p75 THEN 'Alto IQV' ELSE 'Médio IQV' END AS classe, CAST(count(*) AS BIGINT) AS n
FROM orders CROSS JOIN q GROUP BY 1, 2""")
def quartile_class_strict(t: Tables) -> DataFrame:
    classed = quantile_class(t.orders.select("o_orderpriority", "o_totalprice"), "o_totalprice", False, ("Baixo IQV", "Médio IQV", "Alto IQV"))
    return classed.groupBy("o_orderpriority", "classe").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""")
def exact_quantiles_by_flag(t: Tables) -> DataFrame:
    probs = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    return round_all(exact_quantiles(t.lineitem, "l_extendedprice", probs, ["l_returnflag"]), list(probs))


@query(f"""WITH {IQV_SQL}, y AS (SELECT unit, ano, avg("IQV_final") AS v FROM iqv GROUP BY unit, ano)
SELECT CAST(unit AS BIGINT) AS unit, round(avg(v), 6) AS "IQV_final" FROM y GROUP BY unit""", "two_level_mean")
def two_level_mean_index(t: Tables) -> DataFrame:
    out = two_level_mean(_iqv(t), "unit", "ano", ["IQV_final"])
    return out.select(F.col("unit").cast("bigint"), rounded("IQV_final").alias("IQV_final"))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 15 AS w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w) + 1, 15) AS BIGINT) AS bin, round(min(lo + (least(floor((o_totalprice - lo) / w) + 1, 15) - 1) * w), 4) AS left_edge,
  CAST(count(*) AS BIGINT) AS n FROM orders CROSS JOIN b GROUP BY 1""")
def histogram_15(t: Tables) -> DataFrame:
    return histogram(t.orders, "o_totalprice").select(F.col("bin").cast("bigint"), rounded("left_edge", 4).alias("left_edge"), "n")


RATE_NAMES = ["urgent", "high", "medium"]
RATES_SQL = IQV_SQL + f""",
rates AS (SELECT unit, ano, "IQV_final", population, {', '.join(f'{c} * 10000 / nullif(population, 0) AS {c}_10k' for c in RATE_NAMES)},
  ({' + '.join(RATE_NAMES)}) AS total, ({' + '.join(RATE_NAMES)}) * 10000 / nullif(population, 0) AS total_10k FROM iqv)"""


def _rates(t: Tables) -> DataFrame:
    return unit_year_rates(_iqv(t), "unit", "ano", "population", "IQV_final", RATE_NAMES)


@query(f"""WITH {RATES_SQL} SELECT CAST(unit AS BIGINT) AS unit, CAST(ano AS BIGINT) AS ano, {', '.join(f'round({c}_10k, 6) AS {c}_10k' for c in RATE_NAMES)},
  total AS "CRIMES_ANALISADOS_TOTAL", round(total_10k, 6) AS "CRIMES_ANALISADOS_10k" FROM rates""")
def rates_per_10k(t: Tables) -> DataFrame:
    fields = [*[f"{c}_10k" for c in RATE_NAMES], "CRIMES_ANALISADOS_10k"]
    out = round_all(_rates(t).select("unit", "ano", *fields, "CRIMES_ANALISADOS_TOTAL"), fields)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("unit", "ano")})


def _ols_sql(y: str) -> str:
    residual = f"(regr_syy({y}, x) - regr_slope({y}, x) * regr_sxy({y}, x))"
    se = f"sqrt({residual} / ((regr_count({y}, x) - 2) * regr_sxx({y}, x)))"
    return f"""SELECT '{y}' AS response, CAST(regr_count({y}, x) AS BIGINT) AS n, round(regr_slope({y}, x), 6) AS slope, round(regr_intercept({y}, x), 4) AS intercept,
  round(regr_r2({y}, x), 6) AS r2, round({se}, 6) AS slope_se, round(regr_slope({y}, x) / {se}, 6) AS t_value FROM o"""


@query(f"""WITH {RATES_SQL}, o AS (SELECT "IQV_final" AS x, urgent_10k, high_10k, medium_10k FROM rates) {' UNION ALL '.join(_ols_sql(f'{c}_10k') for c in RATE_NAMES)}""")
def ols_by_category(t: Tables) -> DataFrame:
    fitted = ols_by(_rates(t), "IQV_final", [f"{c}_10k" for c in RATE_NAMES])
    return round_all(fitted, ["slope", "r2", "slope_se", "t_value"]).withColumn("intercept", rounded("intercept", 4))


@query("""WITH o AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2
FROM o GROUP BY l_returnflag, l_linestatus""")
def ols_grouped(t: Tables) -> DataFrame:
    fitted = ols_by(t.lineitem, "l_quantity", ["l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return fitted.select("l_returnflag", "l_linestatus", "n", rounded("slope", 4).alias("slope"), rounded("intercept", 2).alias("intercept"), rounded("r2").alias("r2"))


# Rows without index or rate take no part in the fit.
FE_SQL = RATES_SQL + """,
fit AS (SELECT * FROM rates WHERE total_10k IS NOT NULL AND "IQV_final" IS NOT NULL),
g AS (SELECT ano, avg(total_10k) AS yb, avg("IQV_final") AS xb FROM fit GROUP BY ano),
w AS (SELECT r.ano, r.total_10k - g.yb AS y, r."IQV_final" - g.xb AS x, r.total_10k AS raw FROM fit r JOIN g ON g.ano = r.ano),
f AS (SELECT count(*) AS n, count(DISTINCT ano) AS k, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS rss,
  var_pop(raw) * count(*) AS tss FROM w)"""


@query(f"""WITH {FE_SQL} SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS n_effects, round(b, 6) AS slope, round(1 - rss / tss, 6) AS r2,
  round(sqrt(rss / ((n - k - 1) * sxx)), 6) AS slope_se, round(b / sqrt(rss / ((n - k - 1) * sxx)), 6) AS t_value FROM f""")
def ols_year_fixed_effects(t: Tables) -> DataFrame:
    return round_all(ols_fixed_effects(_rates(t), "IQV_final", "CRIMES_ANALISADOS_10k", "ano"), ["slope", "r2", "slope_se", "t_value"])


@query(f"WITH {FE_SQL} SELECT CAST(ano AS BIGINT) AS ano, round(yb - (SELECT b FROM f) * xb, 4) AS intercept FROM g")
def year_effects(t: Tables) -> DataFrame:
    out = effect_intercepts(_rates(t), "IQV_final", "CRIMES_ANALISADOS_10k", "ano")
    return out.select(F.col("ano").cast("bigint"), rounded("intercept", 4).alias("intercept"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT round(lo + (hi - lo) / 99 * i, 6) AS x, round(a + b * (lo + (hi - lo) / 99 * i), 2) AS y FROM f CROSS JOIN generate_series(0, 99) g(i)""")
def regression_line_points(t: Tables) -> DataFrame:
    line = regression_line(t.lineitem, "l_quantity", "l_extendedprice")
    return line.select(rounded("x").alias("x"), rounded("y", 2).alias("y"))
