"""The whole incident and census jobs, fed with text columns made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..plans.census import census_2010, census_2022, numbered
from ..plans.incidents import clean_incidents
from .adapters import incidents
from .catalog import Tables, query, rounded


def _choose(col: str, values: dict[str, str | None], default: str | None = None) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(F.col(col) == key, F.lit(value)).otherwise(out)
    return out


DAYS = ("Domingo", "SEGUNDA", "terça", "Quarta", "quinta", "Sexta", "sábado")


def _raw_incidents(t: Tables, *more: Column) -> DataFrame:
    """Orders written as raw incidents: status gives the place, priority and segment the natures. ``more`` columns follow."""
    return incidents(t).select(
        _choose("o_orderstatus", {"F": "Centro Cívico", "O": "CIC", "P": "Pinhais"}).alias("ATENDIMENTO_BAIRRO_NOME"),
        _choose("o_orderpriority", {"1-URGENT": "AmeaÃ§a", "2-HIGH": "FURTO", "4-NOT SPECIFIED": "Tentativa", "5-LOW": "nada disso"}).alias("NATUREZA1_DESCRICAO"),
        _choose("c_mktsegment", {"BUILDING": "Alagamento", "MACHINERY": None}, "Perturbação do sossego").alias("NATUREZA2_DESCRICAO"),
        _choose("c_mktsegment", {"BUILDING": "05:10:00", "MACHINERY": "13:00:00", "FURNITURE": "24:10:00"}, "21:59:59").alias("OCORRENCIA_HORA"),
        F.array(*[F.lit(d) for d in DAYS])[F.dayofweek("o_orderdate") - 1].alias("OCORRENCIA_DIA_SEMANA"),
        _choose("o_orderpriority", {"1-URGENT": "Sim", "2-HIGH": "1.0"}, "---").alias("FLAG_FLAGRANTE"),
        F.col("o_orderkey").cast("string").alias("OCORRENCIA_CODIGO"), *more,
    )


NAMED = {"violent": "CRIME_VIOLENTO", "property": "CRIME_PATRIMONIAL", "natural_accident": "ACIDENTE_NATURAL", "public_order": "CRIME_ORDEM_PUBLICA"}
#: Categories that none of the raw texts belongs to.
EMPTY = [c for c in vocab.NATURE_CATEGORIES if c not in NAMED.values()]


@query("""
WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'centro civico' WHEN 'O' THEN 'cidade industrial' END AS unit, o_orderpriority AS p, c_mktsegment AS s, dayofweek(o_orderdate) + 1 AS wd
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED'),
c AS (SELECT *, CASE WHEN p = '1-URGENT' THEN 'V' WHEN p = '2-HIGH' THEN 'P' WHEN s = 'BUILDING' THEN 'N' WHEN s <> 'MACHINERY' THEN 'O' END AS k FROM r WHERE NOT (p = '3-MEDIUM' AND s = 'MACHINERY'))
SELECT unit, CAST(wd AS BIGINT) AS weekday, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN p <= '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS caught,
  CAST(sum(CASE WHEN k = 'V' THEN 1 ELSE 0 END) AS BIGINT) AS violent, CAST(sum(CASE WHEN k = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS property,
  CAST(sum(CASE WHEN k = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS natural_accident, CAST(sum(CASE WHEN k = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS public_order,
  CAST(sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, CAST(sum(CASE WHEN s = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS at_dawn,
  CAST(sum(CASE WHEN s = 'FURNITURE' THEN 1 ELSE 0 END) AS BIGINT) AS no_hour,
  """ + ", ".join(f"CAST(0 AS BIGINT) AS {c.lower()}" for c in EMPTY) + """
FROM c GROUP BY 1, 2""")
def incident_cleaning(t: Tables) -> DataFrame:
    cleaned = clean_incidents(_raw_incidents(t), strict=False)
    flagged = sum((F.col(c) for c in vocab.NATURE_CATEGORIES), F.lit(0))
    return cleaned.groupBy(F.col("ATENDIMENTO_BAIRRO_NOME").alias("unit"), F.col("OCORRENCIA_DIA_SEMANA").cast("bigint").alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("FLAG_FLAGRANTE").alias("caught"), *[F.sum(c).alias(n) for n, c in NAMED.items()], *[F.sum(c).alias(c.lower()) for c in EMPTY],
        F.count_if(flagged == 0).alias("unknown"), F.sum("MADRUGADA").alias("at_dawn"), F.count_if(F.col("OCORRENCIA_HORA_HORA").isNull()).alias("no_hour"),
    )


def _census_value(name: str) -> str:
    """A whole number per customer and variable, written as text."""
    return f"cast(floor(abs(c_acctbal) / {100 + int(name[1:])}) AS string) AS {name}"


def _value_sql(*numbers: int) -> str:
    return "sum(" + " + ".join(f"floor(abs(c_acctbal) / {100 + i})" for i in numbers) + ")"


def _share(part: str, whole: str) -> str:
    return f"round(100.0 * {part} / nullif({whole}, 0), 6)"


def _census_2010_sql() -> dict[str, str]:
    """Every column of the 2010 units as SQL over customers."""
    v, whole = _value_sql, lambda *n: f"CAST({_value_sql(*n)} AS DOUBLE)"
    income, read10, read15, old10, old15 = v(20), v(*range(7, 78)), v(*range(12, 78)), v(*range(44, 135)), v(*range(49, 135))
    mean = f"CASE WHEN {v(21)} > 0 THEN {v(22)} / {v(21)} END"
    lacking = {"sem_rede_geral_agua": range(13, 16), "sem_banheiro_sanitario": (23,), "esgotamento_precario": range(19, 24), "lixo_destino_inadequado": range(38, 43)}
    return {
        "populacao": "CAST(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN 10 END) AS DOUBLE)", "pessoas_10_anos_ou_mais": whole(20),
        "pct_sem_rendimento": _share(v(10), income), "pct_rendimento_ate_1_sm": _share(v(1, 2), income), "pct_rendimento_ate_2_sm": _share(v(1, 2), income),
        "pct_rendimento_acima_5_sm": _share(v(6, 7, 8, 9), income), "resp_domicilios_particulares": whole(20),
        "rendimento_medio_responsavel": f"round({mean}, 6)", "rendimento_medio_responsavel_sm": f"round(({mean}) / 510, 6)",
        "pop_10mais": whole(*range(44, 135)), "alfabetizados_10mais": whole(*range(7, 78)), "pct_alfabetizacao_10mais": _share(read10, old10), "pct_analfabetismo_10mais": f"round(100 - 100.0 * {read10} / nullif({old10}, 0), 6)",
        "pop_15mais": whole(*range(49, 135)), "alfabetizados_15mais": whole(*range(12, 78)), "pct_alfabetizacao_15mais": _share(read15, old15), "pct_analfabetismo_15mais": f"round(100 - 100.0 * {read15} / nullif({old15}, 0), 6)",
        "domicilios_particulares_permanentes": whole(2),
        **{k: x for n, numbers in lacking.items() for k, x in ((n, whole(*numbers)), (f"pct_{n}", _share(v(*numbers), v(2))))},
    }


def _census_2022_sql() -> dict[str, str]:
    """Every column of the 2022 units as SQL over customers."""
    n, read, built = "count(*)", "count(CASE WHEN c_acctbal > 0 THEN 1 END)", "count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END)"
    whole = lambda x: f"CAST({x} AS DOUBLE)"
    lacking = {"sem_banheiro_sanitario": built, "esgotamento_precario": f"4 * {built}", "sem_rede_geral_agua": built, "lixo_destino_inadequado": f"4 * {built}", "domicilios_improvisados_estrutura_degradada": f"2 * {n}"}
    return {
        "populacao": whole(n), "resp_domicilios_particulares": whole(n), "moradores_domicilios_particulares": whole(n),
        "rendimento_medio_responsavel": "round(sum(abs(c_acctbal)), 2)", "rendimento_medio_responsavel_sm": "round(sum(abs(c_acctbal)) / 1212, 4)",
        "pop_15mais": whole(f"13 * {n}"), "alfabetizados_15mais": whole(f"13 * {read}"), "pct_alfabetizacao_15mais": _share(read, n), "pct_analfabetismo_15mais": _share(f"({n} - {read})", n),
        "analfabetos_15mais": whole(f"13 * ({n} - {read})"), "domicilios_particulares_permanentemente_ocupados": whole(f"2000 * {n}"),
        **{k: x for c, e in lacking.items() for k, x in ((c, whole(e)), (f"pct_{c}", _share(f"({e})", f"(2000 * {n})")))},
    }


def _units_sql(fields: dict[str, str]) -> str:
    listed = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    return f"SELECT lower(replace(n_name, '_', ' ')) AS unit, {listed} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY n_name"


CENSUS_2010_SQL, CENSUS_2022_SQL = _census_2010_sql(), _census_2022_sql()


@query(_units_sql(CENSUS_2010_SQL))
def census_2010_units(t: Tables) -> DataFrame:
    """Customers as census sectors, nations as neighbourhoods, region 0 as the municipality."""
    def file(columns: list[str], *fixed: str) -> DataFrame:
        return t.customer.selectExpr("cast(c_custkey AS string) AS Cod_setor", *map(_census_value, columns), *fixed)

    places = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 0, vocab.MUNICIPALITY_CODE).otherwise("1").alias("Cod_municipio"))
    basico = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("Cod_setor"), F.col("c_nationkey").cast("string").alias("Cod_bairro"), F.col("n_name").alias("Nome_do_bairro"), "Cod_municipio",
        F.when(F.col("c_mktsegment") == "BUILDING", "X").otherwise("10").alias("V002"),
    )
    renda = file(["V001", "V002", *numbered("V", 6, 10), "V020"], "'X' AS V003")
    resp = file(["V020", "V021", "V022"])
    dom = file(["V002", *numbered("V", 13, 15), *numbered("V", 19, 23), *numbered("V", 38, 42)])
    out = census_2010(basico, renda, resp, file(numbered("V", 7, 77)), file(numbered("V", 44, 134)), dom)
    return out.select(F.col(vocab.UNIT_COLUMN).alias("unit"), *[rounded(f"{c}_2010").alias(c) for c in CENSUS_2010_SQL])


@query(_units_sql(CENSUS_2022_SQL))
def census_2022_units(t: Tables) -> DataFrame:
    """One row per nation with counts written in the published number formats."""
    units = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"),
        F.sum(F.abs("c_acctbal")).alias("balance"),
    )
    key = [F.col("c_nationkey").cast("string").alias("CD_BAIRRO"), F.col("n_name").alias("NM_BAIRRO")]
    units = units.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).persist()
    plain = lambda c: F.col(c).cast("string")
    dotted = F.translate(F.format_number(F.col("n") * 2000, 0), ",", ".")
    basico = units.select(*key, F.when(F.col("n_regionkey") == 0, vocab.MUNICIPALITY_CODE).otherwise("1").alias("CD_MUN"), plain("n").alias("v0001"))
    money = F.translate(F.format_number("balance", 2), ",.", ".,")
    renda = units.select(*key, plain("n").alias("V06001"), plain("n").alias("V06002"), money.alias("V06004"))
    alf = units.select(*key, *[plain("n").alias(c) for c in numbered("V", 644, 656, 5)], *[plain("positive").alias(c) for c in numbered("V", 748, 760, 5)])
    dom1 = units.select(*key, dotted.alias("V00001"), plain("n").alias("V00002"), plain("n").alias("V00052"))
    names = ["V00238", *numbered("V", 312, 314, 5), "V00316", "V00464", *numbered("V", 399, 402, 5)]
    dom2 = units.select(*key, *[plain("building").alias(c) for c in names])
    out = census_2022(basico, renda, alf, dom1, dom2)
    digits = {"rendimento_medio_responsavel": 2, "rendimento_medio_responsavel_sm": 4}
    return out.select(F.col(vocab.UNIT_COLUMN).alias("unit"), *[rounded(f"{c}_2022", digits.get(c, 6)).alias(c) for c in CENSUS_2022_SQL])
