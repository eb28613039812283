"""Small domain files: incident extracts and census tables, all text."""

from __future__ import annotations

from pathlib import Path

NATURES = [f"NATUREZA{i}_DESCRICAO" for i in range(1, 6)]
COMMON = [
    "ATENDIMENTO_BAIRRO_NOME", "EQUIPAMENTO_URBANO_NOME", "FLAG_EQUIPAMENTO_URBANO", "FLAG_FLAGRANTE", "LOGRADOURO_NOME",
    *[f"NATUREZA{i}_DEFESA_CIVIL" for i in range(1, 6)], *NATURES, *[f"SUBCATEGORIA{i}_DESCRICAO" for i in range(1, 6)], "OCORRENCIA_CODIGO",
    "OCORRENCIA_DATA", "OCORRENCIA_DIA_SEMANA", "OCORRENCIA_HORA", "OPERACAO_DESCRICAO", "ORIGEM_CHAMADO_DESCRICAO", "REGIONAL_FATO_NOME",
    "SECRETARIA_NOME", "SECRETARIA_SIGLA", "SERVICO_NOME", "SITUACAO_EQUIPE_DESCRICAO", "NUMERO_PROTOCOLO_156",
]
OLD = ["ATENDIMENTO_ANO", *COMMON]
UNITS = ["CENTRO", "Água Verde", "batel", "CIC"]
KINDS = ["Ameaça", "Furto", "Acidente de Trânsito", "Embriaguez", "Alarmes", "Perturbação do Sossego", "Alagamento"]


def row(columns, **values):
    return [values.get(c, "") for c in columns]


def write(path: Path, columns, rows, sep, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(sep.join(r) for r in [columns, *rows]) + "\n", encoding=encoding)
    return str(path)


def incident_files(root: Path) -> tuple[str, str]:
    """Old extract for 2019-2021 (with dashed row), current one for 2022-2024; every unit, kind and month."""
    old = [["-" * 5] * len(OLD)]
    new = []
    code = 0
    for year in range(2019, 2025):
        for month in range(1, 13):
            for u, unit in enumerate(UNITS):
                for k, kind in enumerate(KINDS):
                    for _ in range((u + 2 * k + month + year) % 3):
                        code += 1
                        common = dict(
                            ATENDIMENTO_BAIRRO_NOME=unit, NATUREZA1_DESCRICAO=kind, OCORRENCIA_CODIGO=str(code), OCORRENCIA_DIA_SEMANA="Terça",
                            OCORRENCIA_HORA="13:30:00", FLAG_FLAGRANTE="SIM", NATUREZA1_DEFESA_CIVIL="0",
                        )
                        if year < 2022:
                            old.append(row(OLD, OCORRENCIA_DATA=f"{year}-{month:02d}-03 00:00:00.000", ATENDIMENTO_ANO=str(year), **common))
                        else:
                            new.append(row(COMMON, OCORRENCIA_DATA=f"3/{month}/{year}", **common))
    extra = [
        dict(ATENDIMENTO_BAIRRO_NOME="pinhais", NATUREZA1_DESCRICAO="Furto", OCORRENCIA_DATA="1/1/2023", OCORRENCIA_CODIGO="x1"),
        dict(ATENDIMENTO_BAIRRO_NOME="CENTRO", NATUREZA1_DESCRICAO="Tentativa", OCORRENCIA_DATA="1/1/2023", OCORRENCIA_CODIGO="x2"),
        dict(ATENDIMENTO_BAIRRO_NOME="CENTRO", OCORRENCIA_DATA="1/1/2023", OCORRENCIA_CODIGO="x3"),
        dict(ATENDIMENTO_BAIRRO_NOME="CENTRO", NATUREZA1_DESCRICAO="Furto", OCORRENCIA_DATA="31/02/2023", OCORRENCIA_CODIGO="x4"),
    ]
    new += [row(COMMON, **e) for e in extra]
    return write(root / "old.csv", OLD, old, ";"), write(root / "new.csv", COMMON, new, ",")


def census_2010_files(root: Path) -> dict[str, str]:
    names = {1: "Centro", 2: "Água Verde", 3: "Batel", 4: "Cidade Industrial de Curitiba"}
    sectors = [(f"s{b}{i}", str(b), names[b]) for b in names for i in range(2)]
    def numbered(lo, hi):
        return [f"V{i:03d}" for i in range(lo, hi + 1)]
    basico_cols = ["Cod_setor", "Cod_bairro", "Nome_do_bairro", "Cod_municipio", "Nome_do_municipio", "V002"]
    basico = [[s, b, n, "4106902", "M", "X" if (b == "3") else "1000"] for s, b, n in sectors] + [
        ["z1", "9", "Outro", "999", "N", "5"], ["z2", "", "", "4106902", "M", "7"],
    ]
    renda_cols = ["Cod_setor", "V001", "V002", "V003", *numbered(6, 10), "V020"]
    resp_cols = ["Cod_setor", "V020", "V021", "V022"]
    alf_cols, idade_cols = ["Cod_setor", *numbered(7, 77)], ["Cod_setor", *numbered(44, 134)]
    dom_cols = ["Cod_setor", "V002", *numbered(13, 15), *numbered(19, 23), *numbered(38, 42)]
    every = [*[s for s, _, _ in sectors], "z1"]
    return {
        "basico": write(root / "Basico.csv", basico_cols, basico, ";"),
        "renda": write(root / "PessoaRenda.csv", renda_cols, [[s, "10", "20", "X", *["5"] * 4, "40", "200"] for s in every], ";"),
        "resp": write(root / "ResponsavelRenda.csv", resp_cols, [[s, "300", "0" if s.startswith("s4") else "100", "102000,5" if s != "s10" else "102000"] for s in every], ";"),
        "alf": write(root / "Pessoa01.csv", alf_cols, [[s, *["2"] * 71] for s in every], ";"),
        "idade": write(root / "Pessoa13.csv", idade_cols, [[s, *["2"] * 91] for s in every], ";"),
        "dom": write(root / "Domicilio01.csv", dom_cols, [[s, "400", *["1"] * 3, *["2"] * 5, *["3"] * 5] for s in every], ";"),
    }


def census_2022_files(root: Path) -> dict[str, str]:
    names = {"11": "Centro", "12": "Água Verde", "13": "Batel", "14": "Cidade Industrial de Curitiba"}
    def numbered(lo, hi):
        return [f"V{i:05d}" for i in range(lo, hi + 1)]
    key = ["CD_BAIRRO", "NM_BAIRRO"]
    def rows(*values):
        return [[code, name, *values] for code, name in names.items()] + [["99", "Outro", *values]]
    dom2 = ["V00238", *numbered(312, 314), "V00316", *numbered(399, 402), "V00464"]
    return {
        "basico": write(root / "basico.csv", ["CD_MUN", "NM_MUN", *key, "v0001"], [["4106902", "M", c, n, "2500"] for c, n in names.items()] + [["1", "N", "99", "Outro", "1"]], ";"),
        "renda": write(root / "renda.csv", [*key, *numbered(6001, 6005)], rows("650", "1800", "0", "3.636,00", "0"), ";"),
        "alf": write(root / "alf.csv", [*key, *numbered(644, 656), *numbered(748, 760)], rows(*["100"] * 13, *["99"] * 12, "1.000"), ";"),
        "dom1": write(root / "dom1.csv", [*key, "V00001", "V00002", "V00052"], rows("1.000", "3", "2"), ";"),
        "dom2": write(root / "dom2.csv", [*key, *dom2], rows(*["4"] * len(dom2)), ";"),
    }
