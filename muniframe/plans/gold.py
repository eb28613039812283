"""Target tables of the relational schema: typed columns, digest keys, checked rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..operators.quality import CORRECTED_CENSUS_YEARS, CORRECTED_RULES, check_constraints, duplicate_keys, not_null_rules, range_rules
from .panel import feature_table

# Column types of the target tables.
TABLES: Mapping[str, str] = {
    "bairros": "id string, nome string, created_at timestamp",
    "categorias_ocorrencia": "id string, codigo string, descricao string, ativa boolean",
    "ocorrencias": "id string, bairro_id string, categoria_id string, dia_ocorrencia smallint, ano smallint, ocorrencia_mes smallint, "
    "ocorrencia_dia_semana smallint, flag_equipamento_urbano boolean, madrugada boolean, manha boolean, tarde boolean, noite boolean, created_at timestamp",
    "bairro_indicadores_anuais": "id string, bairro_id string, ano_censo smallint, log_rendimento double, log_pop double, pct_alfabetizacao_15_mais double, "
    "pct_sem_banheiro_sanitario double, pct_esgotamento_precario double, pct_sem_rede_geral_agua double, pct_lixo_destino_inadequado double, "
    "metodo_estimativa string, created_at timestamp",
    "ibge_bairro_censo": "id string, bairro_id string, ano_censo smallint, log_rendimento double, log_pop double, pct_alfabetizacao_15_mais double, "
    "pct_sem_banheiro_sanitario double, pct_esgotamento_precario double, pct_sem_rede_geral_agua double, pct_lixo_destino_inadequado double, created_at timestamp",
    "bairro_iqv_anual": "id string, bairro_id string, ano smallint, iqv double, created_at timestamp",
}
UNIQUE: Mapping[str, Sequence[str]] = {
    "bairros": ["id"], "categorias_ocorrencia": ["codigo"], "ocorrencias": ["id"],
    "bairro_indicadores_anuais": ["bairro_id", "ano_censo"], "ibge_bairro_censo": ["bairro_id", "ano_censo"], "bairro_iqv_anual": ["bairro_id", "ano"],
    "model_features_contagem_mensal": ["bairro_id", "categoria_id", "periodo_mes"],
}


def digest(*cols: Column) -> Column:
    """Reproducible surrogate key of a natural key."""
    return F.sha2(F.concat_ws("\u0001", *cols), 256)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's columns in order; a missing timestamp takes the load time."""
    out = []
    for field in TABLES[table].split(", "):
        name, kind = field.split(" ")
        value = F.col(name) if name in df.columns else F.current_timestamp() if name == "created_at" else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def unit_dimension(incidents: DataFrame, unit: str) -> DataFrame:
    names = incidents.select(F.col(unit).alias("nome")).dropna().distinct()
    return conform(names.withColumn("id", digest(F.col("nome"))), "bairros")


def category_dimension(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One row per category name (a literal list), active by default."""
    rows = df.sparkSession.createDataFrame([(c, c.replace("_", " ").lower(), True) for c in codes], "codigo string, descricao string, ativa boolean")
    return conform(rows.withColumn("id", digest(F.col("codigo"))), "categorias_ocorrencia")


#: Copies of one row that one task numbers.
COPIES = 100_000


def numbered_copies(df: DataFrame, key: str, out: str) -> DataFrame:
    """The same rows with the number (from 1) of each among those with its ``key``; equal keys mean equal rows.

    Equal rows are counted before the shuffle and written out again from their count, in blocks, so a row that fills a third of the table is
    the work of many tasks."""
    rest = [c for c in df.columns if c != key]
    counted = df.groupBy(key).agg(*[F.first(F.col(c)).alias(c) for c in rest], F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / COPIES))))
    numbers = F.sequence(F.col("__block") * COPIES + 1, F.least(F.col("__n"), (F.col("__block") + 1) * COPIES))
    return blocks.repartition(key, "__block").withColumn(out, F.explode(numbers)).select(key, *rest, out)


def incident_facts(
    incidents: DataFrame, unit: str = vocab.UNIT_COLUMN, categories: Sequence[str] = vocab.NATURE_CATEGORIES
) -> DataFrame:
    """One row per incident and flagged category, keyed by unit and category digests. An incident without a category or unit
    has no fact; a missing period or equipment flag is false. Cleaned incidents have no code left, so the id is a digest of
    the whole row and its number among equal rows."""
    flagged = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in categories]), lambda c: c.isNotNull())
    whole = digest(F.to_json(F.struct(*[F.col(c) for c in incidents.columns]), {"ignoreNullFields": "false"}))
    rows = numbered_copies(incidents.where(F.col(unit).isNotNull()).withColumn("__row", whole), "__row", "__copy").withColumn("__category", F.explode(flagged))
    flag = lambda c: F.coalesce(F.col(c).cast("int") == 1, F.lit(False)) if c in incidents.columns else F.lit(False)
    return conform(rows.select(
        digest(F.col("__row"), F.col("__copy").cast("string"), F.col("__category")).alias("id"), digest(F.col(unit)).alias("bairro_id"), digest(F.col("__category")).alias("categoria_id"),
        F.col("OCORRENCIA_DIA").alias("dia_ocorrencia"), F.col("OCORRENCIA_ANO").alias("ano"), F.col("OCORRENCIA_MES").alias("ocorrencia_mes"),
        F.col("OCORRENCIA_DIA_SEMANA").alias("ocorrencia_dia_semana"), flag("FLAG_EQUIPAMENTO_URBANO").alias("flag_equipamento_urbano"),
        *[flag(c.upper()).alias(c) for c in ("madrugada", "manha", "tarde", "noite")],
    ), "ocorrencias")


def _census_values(rows: DataFrame, unit: str, suffix: str) -> DataFrame:
    n = lambda c: F.col(c + suffix).cast("double")
    lacking = ("sem_banheiro_sanitario", "esgotamento_precario", "sem_rede_geral_agua", "lixo_destino_inadequado")
    values = rows.select(
        digest(F.col(unit)).alias("bairro_id"), F.col("ano").alias("ano_censo"), "metodo_estimativa", F.log1p(n("rendimento_medio_responsavel_sm")).alias("log_rendimento"),
        F.log1p(n("populacao")).alias("log_pop"), n("pct_alfabetizacao_15mais").alias("pct_alfabetizacao_15_mais"), *[n(f"pct_{c}").alias(f"pct_{c}") for c in lacking],
    )
    return values.withColumn("id", digest(F.col("bairro_id"), F.col("ano_censo").cast("string")))


def yearly_table(yearly: DataFrame, unit: str = vocab.UNIT_COLUMN) -> DataFrame:
    """Estimated indicators per unit and year (output of ``yearly_indicators``), with how each was obtained."""
    return conform(_census_values(yearly.withColumn("metodo_estimativa", F.col("tipo_estimativa")), unit, "_estimado"), "bairro_indicadores_anuais")


def census_table(yearly: DataFrame, unit: str = vocab.UNIT_COLUMN) -> DataFrame:
    """The observed census years alone."""
    observed = yearly.where(F.col("tipo_estimativa") == "observado").withColumn("metodo_estimativa", F.col("tipo_estimativa"))
    return conform(_census_values(observed, unit, "_estimado"), "ibge_bairro_censo")


def index_by_year(features: DataFrame, unit: str, year: str = "ano", index: str = "IQV_final") -> DataFrame:
    """Index per (unit, year); it is constant there, so the mean is the value."""
    yearly = features.groupBy(digest(F.col(unit)).alias("bairro_id"), F.col(year).alias("ano")).agg(F.avg(index).alias("iqv"))
    return conform(yearly.withColumn("id", digest(F.col("bairro_id"), F.col("ano").cast("string"))), "bairro_iqv_anual")


def model_features_table(features: DataFrame) -> DataFrame:
    return feature_table(features)


def table_violations(df: DataFrame, table: str, nullable: Sequence[str] = ()) -> DataFrame:
    """(rule, violations) for not-null, range and uniqueness rules of one table."""
    rules = not_null_rules([c for c in df.columns if c not in nullable])
    ranges = {"ocorrencias": "occurrence", "bairro_iqv_anual": "index", "model_features_contagem_mensal": "panel"}.get(table)
    if ranges:
        rules.update(range_rules(CORRECTED_RULES[ranges]))
    if table in ("ibge_bairro_censo", "bairro_indicadores_anuais"):
        first, last = CORRECTED_CENSUS_YEARS if table == "ibge_bairro_censo" else (2009, 2026)
        rules.update(range_rules({"ano_censo": (first, last)}))
    found = check_constraints(df, rules)
    repeated = duplicate_keys(df, UNIQUE[table]).agg(F.lit(f"unique {', '.join(UNIQUE[table])}").alias("rule"), F.count(F.lit(1)).alias("violations"))
    return found.unionByName(repeated)


