"""Yearly indicators from two census anchors, made consistent, attached to incidents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.numeric import clip, keep_or, pct, round_half_even
from ..operators.joins import checked_join

# Indicators present in both census years.
ANCHORED = (
    "populacao", "resp_domicilios_particulares", "rendimento_medio_responsavel_sm", "pop_15mais", "alfabetizados_15mais",
    "domicilios_particulares_ocupados", "sem_banheiro_sanitario", "esgotamento_precario", "sem_rede_geral_agua",
    "lixo_destino_inadequado",
)


def join_census_years(census_2010: DataFrame, census_2022: DataFrame) -> DataFrame:
    """Both census years side by side, household denominators under one name."""
    joined = census_2010.join(census_2022, vocab.UNIT_COLUMN)
    return joined.withColumnsRenamed({
        "domicilios_particulares_permanentes_2010": "domicilios_particulares_ocupados_2010",
        "domicilios_particulares_permanentemente_ocupados_2022": "domicilios_particulares_ocupados_2022",
    })


def interpolate_years(
    df: DataFrame, unit: str, variables: Sequence[str] = ANCHORED, y0: int = 2010, y1: int = 2022, lo: int = 2009, hi: int = 2026,
    year: str = "ano", suffix: str = "_estimado", carry: Sequence[str] = (),
) -> DataFrame:
    """Straight line through two anchors for every year in [lo, hi]; a missing anchor gives null.

    Expects ``<variable>_<y0>`` and ``<variable>_<y1>``. No shuffle: the years come
    from an exploded sequence and the line is evaluated per row.
    """
    years = df.withColumn(year, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    kind = (
        F.when(F.col(year).isin(y0, y1), "observado").when(F.col(year).between(y0, y1), "interpolado").otherwise("extrapolado")
    )
    lines = []
    for v in variables:
        a, b = F.col(f"{v}_{y0}").cast("double"), F.col(f"{v}_{y1}").cast("double")
        slope = (b - a) / float(y1 - y0)
        lines.append((slope * (F.col(year) - y0) + a).alias(v + suffix))
    return years.select(unit, year, kind.alias("tipo_estimativa"), *lines, *carry)


@dataclass(frozen=True)
class ConsistencyColumns:
    """Column names the rules work on, without suffix."""

    population: str = "pop_15mais"
    literate: str = "alfabetizados_15mais"
    illiterate: str = "analfabetos_15mais"
    literacy_rate: str = "pct_alfabetizacao_15mais"
    illiteracy_rate: str = "pct_analfabetismo_15mais"
    households: str = "domicilios_particulares_ocupados"
    lacking: tuple[str, ...] = ("sem_banheiro_sanitario", "esgotamento_precario", "sem_rede_geral_agua", "lixo_destino_inadequado")
    whole: tuple[str, ...] = ("populacao", "resp_domicilios_particulares")
    two_decimals: tuple[str, ...] = ("rendimento_medio_responsavel_sm",)
    suffix: str = "_estimado"


def apply_consistency(df: DataFrame, year: str, last_rate: str, cols: ConsistencyColumns = ConsistencyColumns(), last_year: int = 2022) -> DataFrame:
    """Hold the last literacy rate, bound rates and counts, recompute shares, round.

    ``last_rate`` is the literacy rate observed in ``last_year``; it is dropped at the
    end. A null lacking-count becomes the household count (a null comparison is false).
    """
    n = lambda name: name + cols.suffix
    pop, homes = F.col(n(cols.population)), F.col(n(cols.households))

    rate = pct(F.col(n(cols.literate)), pop)
    df = df.withColumn(n(cols.literacy_rate), clip(F.when(F.col(year) > last_year, F.col(last_rate)).otherwise(rate), 0.0, 100.0))
    df = df.withColumn(n(cols.literate), pop * F.col(n(cols.literacy_rate)) / 100)
    df = df.withColumn(n(cols.illiterate), pop - F.col(n(cols.literate)))
    df = df.withColumn(n(cols.illiteracy_rate), pct(F.col(n(cols.illiterate)), pop))
    empty = F.coalesce(pop <= 0, F.lit(False))
    df = df.withColumns({n(c): F.when(~empty, F.col(n(c))) for c in (cols.literacy_rate, cols.illiteracy_rate)})

    df = df.withColumn(n(cols.households), clip(homes, lo=0.0))
    df = df.withColumns({n(c): clip(F.col(n(c)), lo=0.0) for c in cols.lacking})
    df = df.withColumns({n(c): keep_or(F.col(n(c)), F.col(n(c)) <= homes, homes) for c in cols.lacking})
    df = df.withColumns({f"pct_{n(c)}": F.when(homes > 0, F.col(n(c)) / homes * 100) for c in cols.lacking})

    whole = [*cols.whole, cols.population, cols.literate, cols.illiterate, cols.households, *cols.lacking]
    rates = [*cols.two_decimals, cols.literacy_rate, cols.illiteracy_rate, *[f"pct_{c}" for c in cols.lacking]]
    df = df.withColumns({
        **{n(c): round_half_even(F.col(n(c))).cast("bigint") for c in whole},
        **{n(c): round_half_even(F.col(n(c)), 2) for c in rates},
    })
    return df.drop(last_rate)


def yearly_indicators(census_2010: DataFrame, census_2022: DataFrame) -> DataFrame:
    """Both censuses to consistent yearly indicators, 2009 to 2026."""
    rate = "pct_alfabetizacao_15mais_2022"
    both = join_census_years(census_2010, census_2022)
    return apply_consistency(interpolate_years(both, vocab.UNIT_COLUMN, carry=[rate]), "ano", rate)


def attach_yearly(incidents: DataFrame, yearly: DataFrame, unit: str, incident_year: str, year: str = "ano") -> DataFrame:
    """Incidents with the indicators of their unit and year; fails if (unit, year) repeats.

    The year joins as a long; incidents keep their row count.
    """
    right = yearly.withColumn("__year", F.col(year).cast("bigint"))
    left = incidents.withColumn("__year", F.col(incident_year).cast("bigint"))
    return checked_join(left, right, [unit, "__year"], "left", "m:1").drop("__year")
