"""Census extracts to one indicator row per neighbourhood.

All inputs are all-string frames as read from the published CSV files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.lookup import recode
from ..functions.numeric import array_sum, parse_census_number, parse_ptbr_number, pct, positive_ratio, to_number
from ..functions.text import clean_text

SECTOR = "Cod_setor"
UNIT_2010 = ["Cod_bairro", "Nome_do_bairro"]
UNIT_2022 = ["CD_BAIRRO", "NM_BAIRRO"]


def numbered(prefix: str, first: int, last: int, width: int = 3) -> list[str]:
    """Census variable names ``V007 ... V077``."""
    return [f"{prefix}{i:0{width}d}" for i in range(first, last + 1)]


def total(*names: str) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def sector_dimension(basico: DataFrame, municipality: str) -> DataFrame:
    """Sector to neighbourhood map of one municipality."""
    inside = basico.where(F.col("Cod_municipio") == municipality)
    return inside.select(SECTOR, *UNIT_2010).dropna(subset=[SECTOR, "Cod_bairro"]).distinct()


def _named(df: DataFrame, name: str, suffix: str, code: str, fixes: Mapping[str, str]) -> DataFrame:
    """Drop the code, clean and fix the name, suffix the indicators."""
    unit = recode(recode(clean_text(F.col(name)), vocab.UNIT_FIXES), fixes)
    values = [c for c in df.columns if c not in (name, code)]
    renamed = [F.col(c).alias(c if c.endswith(suffix) else c + suffix) for c in values]
    return df.select(unit.alias(vocab.UNIT_COLUMN), *renamed)


def census_2010(
    basico: DataFrame, renda: DataFrame, resp: DataFrame, alf: DataFrame, idade: DataFrame, dom: DataFrame,
    municipality: str = vocab.MUNICIPALITY_CODE,
) -> DataFrame:
    """Sector files rolled up to neighbourhoods: all files as one union by sector, one join with the dimension, one aggregate.

    A neighbourhood has the indicators of the files that have any of its sectors; those of the household heads need the income file
    too, those of schooling both of its files."""
    parts: list[DataFrame] = []

    def part(df: DataFrame, prefix: str, cols: Sequence[str], totals: Mapping[str, int] | None = None) -> None:
        """Cells of ``cols``, or row totals that start at a position of ``cols``; all cells go through one parsing expression, and
        row-wise totals come before the shuffle."""
        cells = df.select(SECTOR, F.transform(F.array(*cols), lambda x: parse_census_number(x)).alias("v"))
        if totals is None:
            out = {c: F.col("v")[i] for i, c in enumerate(cols)}
        else:
            out = {name: array_sum(F.slice("v", start + 1, len(cols) - start)) for name, start in totals.items()}
        parts.append(cells.select(SECTOR, F.lit(prefix).alias("__file"), *[c.cast("double").alias(f"{prefix}_{n}") for n, c in out.items()]))

    part(renda, "renda", ["V001", "V002", "V003", "V006", "V007", "V008", "V009", "V010", "V020"])
    part(resp, "resp", ["V020", "V021", "V022"])
    # The 15+ totals leave out the first five single-year columns (ages 10 to 14).
    part(alf, "alf", numbered("V", 7, 77), {"10mais": 0, "15mais": 5})
    part(idade, "idade", numbered("V", 44, 134), {"10mais": 0, "15mais": 5})
    part(dom, "dom", ["V002", *numbered("V", 13, 15), *numbered("V", 19, 23), *numbered("V", 38, 42)])

    sums = [c for p in parts for c in p.columns[2:]]
    by_sector = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(sector_dimension(basico, municipality), SECTOR).drop(SECTOR)
    people = basico.where(F.col("Cod_municipio") == municipality).select(*UNIT_2010, F.lit("basico").alias("__file"), to_number(F.col("V002")).cast("double").alias("people"))
    rows = by_sector.unionByName(people, allowMissingColumns=True).dropna(subset=UNIT_2010)
    files = ["renda", "resp", "alf", "idade", "dom"]
    units = rows.groupBy(*UNIT_2010).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], F.sum("people").alias("populacao_2010"),
        *[(F.count_if(F.col("__file") == f) > 0).alias(f"in_{f}") for f in files],
    )

    at = lambda file, *names: total(*[f"{file}_{n}" for n in names])
    there = lambda file, *named: [F.when(F.col(f"in_{file}"), c).alias(n) for n, c in named]
    base, mean_income = at("renda", "V020"), positive_ratio(at("resp", "V022"), at("resp", "V021"))
    units = units.withColumns({"in_resp": F.col("in_renda") & F.col("in_resp"), "in_school": F.col("in_alf") & F.col("in_idade")})
    rate10 = pct(at("alf", "10mais"), at("idade", "10mais"))
    rate15 = pct(at("alf", "15mais"), at("idade", "15mais"))
    homes = at("dom", "V002")
    lacking = {
        "sem_rede_geral_agua": at("dom", *numbered("V", 13, 15)),
        "sem_banheiro_sanitario": at("dom", "V023"),
        "esgotamento_precario": at("dom", *numbered("V", 19, 23)),
        "lixo_destino_inadequado": at("dom", *numbered("V", 38, 42)),
    }
    wide = units.select(
        *UNIT_2010, "populacao_2010",
        *there(
            "renda", ("pessoas_10_anos_ou_mais", base), ("pct_sem_rendimento", pct(at("renda", "V010"), base)),
            ("pct_rendimento_ate_1_sm", pct(at("renda", "V001", "V002"), base)), ("pct_rendimento_ate_2_sm", pct(at("renda", "V001", "V002", "V003"), base)),
            ("pct_rendimento_acima_5_sm", pct(at("renda", "V006", "V007", "V008", "V009"), base)),
        ),
        *there(
            "resp", ("resp_domicilios_particulares", at("resp", "V020")), ("rendimento_medio_responsavel", mean_income),
            ("rendimento_medio_responsavel_sm", mean_income / vocab.MINIMUM_WAGE[2010]),
        ),
        *there(
            "school", ("pop_10mais", at("idade", "10mais")), ("alfabetizados_10mais", at("alf", "10mais")), ("pct_alfabetizacao_10mais", rate10),
            ("pct_analfabetismo_10mais", 100 - rate10), ("pop_15mais", at("idade", "15mais")), ("alfabetizados_15mais", at("alf", "15mais")),
            ("pct_alfabetizacao_15mais", rate15), ("pct_analfabetismo_15mais", 100 - rate15),
        ),
        *there("dom", ("domicilios_particulares_permanentes", homes), *[x for n, c in lacking.items() for x in ((n, c), (f"pct_{n}", pct(c, homes)))]),
    )
    return _named(wide, "Nome_do_bairro", "_2010", "Cod_bairro", vocab.CENSUS_2010_UNIT_FIXES)


def census_2022(
    basico: DataFrame, renda: DataFrame, alf: DataFrame, dom1: DataFrame, dom2: DataFrame, municipality: str = vocab.MUNICIPALITY_CODE
) -> DataFrame:
    """Neighbourhood files of one municipality as one union and one aggregate; fails when a neighbourhood repeats in a file other than ``basico``.

    Household indicators need both of their files."""
    inside = basico.where(F.col("CD_MUN") == municipality)
    codes = inside.select(F.trim(F.col("CD_BAIRRO")).alias("__code")).distinct()
    parts: list[DataFrame] = []

    def part(df: DataFrame, file: str, cols: Mapping[str, Column]) -> None:
        parts.append(df.select(*UNIT_2022, F.lit(file).alias("__file"), *[c.cast("double").alias(n) for n, c in cols.items()]))

    def parsed(cols: Sequence[str]) -> dict[str, Column]:
        return {c: parse_ptbr_number(F.col(c)) for c in cols}

    part(renda, "renda", {"heads": to_number(F.col("V06001")), "dwellers": to_number(F.col("V06002")), "pay": parse_ptbr_number(F.col("V06004"))})
    # Literacy cells keep their separators: only plain numbers count.
    summed = lambda first, last: array_sum(F.transform(F.array(*numbered("V", first, last, 5)), to_number))
    part(alf, "alf", {"pop15": summed(644, 656), "read15": summed(748, 760)})
    part(dom1, "dom1", parsed(["V00001", "V00002", "V00052"]))
    part(dom2, "dom2", parsed(["V00238", *numbered("V", 312, 314, 5), "V00316", "V00464", *numbered("V", 399, 402, 5)]))
    local = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(codes, F.trim("CD_BAIRRO") == F.col("__code"), "left_semi")
    people = inside.select(*UNIT_2022, F.lit("basico").alias("__file"), to_number(F.col("v0001")).cast("double").alias("populacao_2022")).dropna(subset=UNIT_2022)
    files = ["renda", "alf", "dom1", "dom2"]
    cells = [c for p in parts for c in p.columns[3:]]
    units = local.unionByName(people, allowMissingColumns=True).groupBy(*UNIT_2022).agg(
        F.sum("populacao_2022").alias("populacao_2022"), *[F.sum(c).alias(c) for c in cells], *[F.count_if(F.col("__file") == f).alias(f"n_{f}") for f in files]
    )
    repeated = F.concat(F.lit("a census file is not unique on "), F.to_json(F.struct(*UNIT_2022)))
    units = units.where(F.assert_true(F.greatest(*[F.col(f"n_{f}") for f in files]) <= 1, repeated).isNull())
    missing = F.col("pop15") - F.col("read15")
    both = (F.col("n_dom1") == 1) & (F.col("n_dom2") == 1) & F.col("NM_BAIRRO").isNotNull()
    home = lambda *names: F.when(both, reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in names]))
    occupied = home("V00001")
    lacking = {
        "sem_banheiro_sanitario": home("V00238"),
        "esgotamento_precario": home(*numbered("V", 312, 314, 5), "V00316"),
        "sem_rede_geral_agua": home("V00464"),
        "lixo_destino_inadequado": home(*numbered("V", 399, 402, 5)),
        "domicilios_improvisados_estrutura_degradada": home("V00002", "V00052"),
    }
    wide = units.select(
        *UNIT_2022, "populacao_2022", F.col("heads").alias("resp_domicilios_particulares"), F.col("dwellers").alias("moradores_domicilios_particulares"),
        F.col("pay").alias("rendimento_medio_responsavel"), (F.col("pay") / vocab.MINIMUM_WAGE[2022]).alias("rendimento_medio_responsavel_sm"),
        F.col("pop15").alias("pop_15mais"), F.col("read15").alias("alfabetizados_15mais"),
        pct(F.col("read15"), F.col("pop15")).alias("pct_alfabetizacao_15mais"), pct(missing, F.col("pop15")).alias("pct_analfabetismo_15mais"), missing.alias("analfabetos_15mais"),
        occupied.alias("domicilios_particulares_permanentemente_ocupados"),
        *[x for n, c in lacking.items() for x in (c.alias(n), pct(c, occupied).alias(f"pct_{n}"))],
    )
    return _named(wide, "NM_BAIRRO", "_2022", "CD_BAIRRO", vocab.CENSUS_2022_UNIT_FIXES)
