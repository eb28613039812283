"""Unified extracts, strict casts, census years, maps, the index table and the target tables on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.numeric import cast_columns
from ..operators.joins import checked_join
from ..operators.ordering import first_per_group
from ..operators.quality import require_rows
from ..plans.gold import census_table, incident_facts, table_violations, yearly_table
from ..plans.incidents import clean_incidents, unify_incidents
from ..plans.index import NEGATIVE, POSITIVE, index_features
from ..plans.indicators import join_census_years
from ..plans.maps import map_indicators, unit_means
from .adapters import IQV_SQL, UNIT_YEAR_SQL, unit_year
from .catalog import Tables, query, rounded
from .domain_queries import _raw_incidents


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS ano, CAST(month(o_orderdate) AS BIGINT) AS mes, CAST(day(o_orderdate) AS BIGINT) AS dia, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2, 3""")
def unified_extracts(t: Tables) -> DataFrame:
    """Orders as an old extract with timestamps and a ruler line, and a current one with day/month/year; one schema, each order once."""
    code, price = F.col("o_orderkey").cast("string").alias(vocab.CODE_COLUMN), F.col("o_totalprice").alias("total")
    old = t.orders.where("year(o_orderdate) < 1998").select(code, price, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS").alias(vocab.DATE_COLUMN), F.year("o_orderdate").alias("ATENDIMENTO_ANO"))
    ruler = t.region.select(F.lit("---").alias(vocab.CODE_COLUMN), F.lit(0.0).alias("total"), F.lit("-------").alias(vocab.DATE_COLUMN), F.lit(0).alias("ATENDIMENTO_ANO"))
    new = t.orders.where("year(o_orderdate) >= 1998").select(price, F.date_format("o_orderdate", "d/M/yyyy").alias(vocab.DATE_COLUMN), code)
    both = unify_incidents(old.unionByName(ruler), new)
    return both.groupBy(F.col("OCORRENCIA_ANO").alias("ano"), F.col("OCORRENCIA_MES").alias("mes"), F.col("OCORRENCIA_DIA").alias("dia")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS open_quantity FROM lineitem GROUP BY 1")
def strict_casts(t: Tables) -> DataFrame:
    """Whole numbers that must parse, and numbers whose bad values become null."""
    text = t.lineitem.select("l_returnflag", F.col("l_orderkey").cast("string").alias("k"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).otherwise("n/a").alias("q"))
    return cast_columns(text, ["k"], ["q"]).groupBy("l_returnflag").agg(F.sum("k").alias("keys"), F.round(F.sum("q"), 2).alias("open_quantity"))


@query("""SELECT o_custkey, CAST(arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS first_order, CAST(min(o_orderdate) AS DATE) AS first_date FROM orders GROUP BY 1""")
def first_order_per_customer(t: Tables) -> DataFrame:
    first = first_per_group(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderdate").cast("date").alias("first_date"))


@query("""SELECT c_nationkey AS unit, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN 1 ELSE 0 END) AS BIGINT) AS old, CAST(sum(CASE WHEN year(o_orderdate) = 2000 THEN 1 ELSE 0 END) AS BIGINT) AS new
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 5 OR year(o_orderdate) <> 2000 GROUP BY 1 HAVING old > 0 AND new > 0""")
def census_years_joined(t: Tables) -> DataFrame:
    """Two years side by side by unit; a unit that one of them lacks is left out."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias(vocab.UNIT_COLUMN), F.year("o_orderdate").alias("ano"))
    counted = lambda year, name: rows.where(F.col("ano") == year).groupBy(vocab.UNIT_COLUMN).agg(F.count(F.lit(1)).alias(name))
    old, new = counted(1996, "domicilios_particulares_permanentes_2010"), counted(2000, "domicilios_particulares_permanentemente_ocupados_2022").where(F.col(vocab.UNIT_COLUMN) != 5)
    joined = join_census_years(old, new)
    return joined.select(F.col(vocab.UNIT_COLUMN).alias("unit"), F.col("domicilios_particulares_ocupados_2010").alias("old"), F.col("domicilios_particulares_ocupados_2022").alias("new"))


@query(f"""WITH {UNIT_YEAR_SQL}, places AS (SELECT n_nationkey AS k, n_name AS nome FROM nation UNION ALL SELECT NULL, r_name FROM region)
SELECT nome, round(avg(price), 4) AS price, round(avg(urgency), 6) AS urgency FROM places LEFT JOIN uy ON uy.unit = k GROUP BY nome""")
def map_means(t: Tables) -> DataFrame:
    """Nations and regions as polygons with the year-balanced means of the nations, joined by name."""
    named = unit_year(t).join(t.nation, F.col("unit") == F.col("n_nationkey")).withColumn("place", F.concat(F.lit("  "), F.lower("n_name")))
    means = unit_means(named, "place", "ano", ["price", "urgency"])
    polygons = t.nation.select(F.col("n_name").alias("nome")).unionByName(t.region.select(F.col("r_name").alias("nome")))
    return map_indicators(polygons, means).select("nome", rounded("price", 4).alias("price"), rounded("urgency").alias("urgency"))


@query(f"""WITH {IQV_SQL.replace("FROM uy CROSS JOIN b", "FROM uy CROSS JOIN b WHERE ano <> 2001").replace("FROM uy),", "FROM uy WHERE ano <> 2001),")}
SELECT unit, ano, CAST(CASE WHEN urgent > 20 OR high > 20 THEN 1 ELSE 0 END AS BIGINT) AS outros, round(ln(1 + price), 6) AS log_rendimento, round("IQV", 4) AS iqv FROM iqv""")
def index_feature_rows(t: Tables) -> DataFrame:
    """Unit-years with pooled class, logs and the index; the running year is left out."""
    names = dict(zip(("price", "finished", "pending", "urgency", "building", "spread"), (*POSITIVE, *NEGATIVE)))
    rows = unit_year(t).select("unit", "ano", (F.col("urgent") > 20).cast("int").alias("urgent"), (F.col("high") > 20).cast("int").alias("high"), F.col("population").alias("populacao_estimado"), *[F.col(c).alias(n) for c, n in names.items()])
    out = index_features(rows, ["urgent", "high"], last_full_year=2000)
    return out.select("unit", F.col("ano").cast("long").alias("ano"), F.col("OUTROS").cast("long").alias("outros"), rounded("log_rendimento").alias("log_rendimento"), rounded("IQV", 4).alias("iqv"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def rows_kept_by_join(t: Tables) -> DataFrame:
    """A left join to one row at most keeps the number of rows; a different number would fail."""
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    joined = checked_join(t.orders, customers, ["o_custkey"], "left", "m:1")
    return require_rows(joined, t.orders.count(), "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("nations"))


FACTS = {"V": "CRIME_VIOLENTO", "P": "CRIME_PATRIMONIAL", "N": "ACIDENTE_NATURAL", "O": "CRIME_ORDEM_PUBLICA"}


@query(f"""
WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'centro civico' ELSE 'cidade industrial' END AS unit, o_orderpriority AS p, c_mktsegment AS s, o_orderdate AS d
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED'),
c AS (SELECT *, CASE WHEN p = '1-URGENT' THEN 'V' WHEN p = '2-HIGH' THEN 'P' WHEN s = 'BUILDING' THEN 'N' WHEN s <> 'MACHINERY' THEN 'O' END AS k FROM r)
SELECT sha256(unit) AS bairro_id, sha256(CASE k {' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in FACTS.items())} END) AS categoria_id, CAST(year(d) AS BIGINT) AS ano,
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS ids, CAST(sum(CASE WHEN s = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS at_dawn
FROM c WHERE k IS NOT NULL GROUP BY unit, k, year(d)""")
def gold_incident_facts(t: Tables) -> DataFrame:
    """Cleaned incidents as facts, every one twice: equal rows get ids of their own. Half of the counts are shown."""
    raw = _raw_incidents(t, F.year("o_orderdate").alias("OCORRENCIA_ANO"), F.month("o_orderdate").alias("OCORRENCIA_MES"), F.dayofmonth("o_orderdate").alias("OCORRENCIA_DIA")).drop("OCORRENCIA_CODIGO")
    facts = incident_facts(clean_incidents(raw.unionByName(raw), strict=False))
    half = lambda c: (c / 2).cast("long")
    return facts.groupBy("bairro_id", "categoria_id", F.col("ano").cast("long").alias("ano")).agg(
        half(F.count(F.lit(1))).alias("n"), half(F.count_distinct("id")).alias("ids"), half(F.sum(F.col("madrugada").cast("int"))).alias("at_dawn")
    )


LACKING = ("sem_banheiro_sanitario", "esgotamento_precario", "sem_rede_geral_agua", "lixo_destino_inadequado")


@query(f"""WITH {UNIT_YEAR_SQL},
shifted AS (SELECT 'yearly' AS kind, ano + 14 AS year, price, population, urgency, finished FROM uy UNION ALL SELECT 'census', ano + 14, price, population, urgency, finished FROM uy WHERE ano + 14 IN (2010, 2014))
SELECT kind, CAST(year AS BIGINT) AS ano_censo, CAST(count(*) AS BIGINT) AS n, round(sum(ln(1 + price)), 4) AS log_rendimento, round(sum(ln(1 + population)), 4) AS log_pop,
  round(sum(100 * urgency), 4) AS pct_alfabetizacao_15_mais, round(sum({len(LACKING)} * 100 * finished), 4) AS lacking, CAST(0 AS BIGINT) AS violations
FROM shifted GROUP BY kind, year""")
def gold_yearly_tables(t: Tables) -> DataFrame:
    """Yearly and census target tables from unit-years, moved by 14 years into the range the rules allow, with the sum of broken rules."""
    year = F.col("ano") + 14
    yearly = unit_year(t).select(
        F.col("unit").cast("string").alias(vocab.UNIT_COLUMN), year.alias("ano"), F.when(year.isin(2010, 2014), "observado").otherwise("interpolado").alias("tipo_estimativa"),
        F.col("price").alias("rendimento_medio_responsavel_sm_estimado"), F.col("population").alias("populacao_estimado"),
        (F.col("urgency") * 100).alias("pct_alfabetizacao_15mais_estimado"), *[(F.col("finished") * 100).alias(f"pct_{c}_estimado") for c in LACKING],
    )
    out = None
    for kind, table, name in (("yearly", yearly_table(yearly), "bairro_indicadores_anuais"), ("census", census_table(yearly), "ibge_bairro_censo")):
        rules = table_violations(table, name).where("rule NOT LIKE '%ano_censo%'").agg(F.sum("violations").alias("v"))
        rows = table.groupBy(F.col("ano_censo").cast("long").alias("ano_censo")).agg(
            F.count(F.lit(1)).alias("n"), rounded(F.sum("log_rendimento"), 4).alias("log_rendimento"), rounded(F.sum("log_pop"), 4).alias("log_pop"),
            rounded(F.sum("pct_alfabetizacao_15_mais"), 4).alias("pct_alfabetizacao_15_mais"), rounded(sum((F.sum(f"pct_{c}") for c in LACKING), F.lit(0.0)), 4).alias("lacking"),
        )
        part = rows.select(F.lit(kind).alias("kind"), "*", F.coalesce(rules.scalar(), F.lit(0)).cast("long").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out
