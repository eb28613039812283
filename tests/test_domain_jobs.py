import math

import pytest
from pyspark.sql import functions as F

import domain
from muniframe import vocab
from muniframe.operators.joins import checked_join, key_difference
from muniframe.plans.census import census_2010, census_2022
from muniframe.operators.quality import fk_orphans
from muniframe.plans.gold import (
    category_dimension, census_table, incident_facts, index_by_year, model_features_table, table_violations, unit_dimension, yearly_table,
)
from muniframe.plans.incidents import clean_incidents, invalid_dates, overlapping_codes, split_date, unify_incidents, unmapped_values
from muniframe.plans.indicators import apply_consistency, attach_yearly, interpolate_years
from muniframe.plans.jobs import build_index, build_panel, build_yearly, clean_incident_files
from muniframe.plans.maps import map_classes, map_indicators, unit_means
from muniframe.sources.files import read_delimited
from muniframe.sources.geojson import read_geojson


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tmp_path_factory.mktemp("domain")


@pytest.fixture(scope="module")
def incidents(spark, root):
    old, new = domain.incident_files(root)
    return clean_incident_files(spark, old, new, str(root / "clean"), str(root / "clean_csv"))


@pytest.fixture(scope="module")
def yearly(spark, root):
    return build_yearly(spark, domain.census_2010_files(root / "c10"), domain.census_2022_files(root / "c22"), str(root / "yearly"))


def test_unify_drops_unparseable_dates(spark, root):
    old, new = (read_delimited(spark, p, s) for p, s in zip(domain.incident_files(root / "u"), ";,"))
    both = unify_incidents(old, new)
    assert "ATENDIMENTO_ANO" not in both.columns and "OCORRENCIA_DATA" not in both.columns
    assert both.count() == old.count() - 1 + new.count() - 1
    assert both.agg(F.min("OCORRENCIA_ANO"), F.max("OCORRENCIA_ANO")).first() == (2019, 2024)


def test_invalid_dates_and_overlap(spark):
    rows = [(1, "1/2/2024"), (2, "31/2/2024"), (3, " "), (4, None), (5, "-----")]
    df = spark.createDataFrame(rows, "n long, OCORRENCIA_DATA string")
    assert sorted(map(tuple, invalid_dates(df, "OCORRENCIA_DATA", "d/M/y", "n").collect())) == [(3, "31/2/2024"), (6, "-----")]
    codes = lambda values: spark.createDataFrame([(v, 2022, m) for v, m in values], "OCORRENCIA_CODIGO string, OCORRENCIA_ANO long, OCORRENCIA_MES long")
    a, b = codes([("a ", 11), ("b", 10), ("c", 11), (None, 11)]), codes([("a", 11), ("b", 11), (None, 11)])
    assert [r[0] for r in overlapping_codes(a, b).collect()] == ["a"]
    assert split_date(a, "absent", "y") is a


def test_clean_incidents(incidents):
    units = {r[0] for r in incidents.select(vocab.UNIT_COLUMN).distinct().collect()}
    assert units == {"centro", "agua verde", "batel", "cidade industrial"}
    flags = [F.col(c) for c in vocab.NATURE_CATEGORIES]
    total = sum(flags[1:], flags[0])
    row = incidents.agg(F.min(total), F.max(total), F.min("TARDE"), F.min("OCORRENCIA_DIA_SEMANA"), F.min("FLAG_FLAGRANTE"), F.sum("CRIME_PATRIMONIAL")).first()
    assert tuple(row)[:5] == (1, 1, 1, 3, 1) and row[5] > 0
    assert not set(vocab.DROP_COLUMNS) & set(incidents.columns)


def test_cleaned_csv_round_trip(spark, root, incidents):
    back = read_delimited(spark, str(root / "clean_csv"), ";", "UTF-8")
    assert back.count() == incidents.count() and back.columns == incidents.columns


def test_first_known_nature_wins_and_unknown_fails(spark):
    cols = [vocab.UNIT_COLUMN, *domain.NATURES]
    def frame(*natures):
        return spark.createDataFrame([("centro", *natures)], ", ".join(f"{c} string" for c in cols))
    out = clean_incidents(frame(None, "?? desconhecida", "ameaÃ§a", "furto", None)).first()
    assert out["CRIME_VIOLENTO"] == 1 and out["CRIME_PATRIMONIAL"] == 0
    unknown = frame("coisa nova", None, None, None, None)
    with pytest.raises(Exception, match="no category for: coisa nova"):
        clean_incidents(unknown).collect()
    assert [r[0] for r in unmapped_values(unknown, domain.NATURES, vocab.NATURE_CATEGORIES, vocab.NATURE_FIXES, vocab.UNDETERMINED_NATURES).collect()] == ["coisa nova"]
    assert clean_incidents(unknown, strict=False).first()["CRIME_VIOLENTO"] == 0


def test_census_2010(spark, root):
    files = {k: read_delimited(spark, p) for k, p in domain.census_2010_files(root / "a").items()}
    rows = {r[vocab.UNIT_COLUMN]: r for r in census_2010(**files).collect()}
    assert set(rows) == {"centro", "agua verde", "batel", "cidade industrial"}
    c = rows["centro"]
    assert c["populacao_2010"] == 2000 and rows["batel"]["populacao_2010"] is None
    assert c["pct_rendimento_ate_2_sm_2010"] == pytest.approx(60 / 400 * 100)
    assert c["pct_rendimento_acima_5_sm_2010"] == pytest.approx(40 / 400 * 100)
    assert c["rendimento_medio_responsavel_2010"] == pytest.approx((102000 + 102000.5) / 200)
    assert c["rendimento_medio_responsavel_sm_2010"] == pytest.approx((102000 + 102000.5) / 200 / 510)
    assert rows["cidade industrial"]["rendimento_medio_responsavel_2010"] is None
    assert (c["alfabetizados_10mais_2010"], c["alfabetizados_15mais_2010"], c["pop_10mais_2010"], c["pop_15mais_2010"]) == (284, 264, 364, 344)
    assert c["pct_analfabetismo_15mais_2010"] == pytest.approx(100 - 264 / 344 * 100)
    assert (c["sem_rede_geral_agua_2010"], c["sem_banheiro_sanitario_2010"], c["esgotamento_precario_2010"], c["lixo_destino_inadequado_2010"]) == (6, 4, 20, 30)
    assert c["pct_lixo_destino_inadequado_2010"] == pytest.approx(30 / 800 * 100)


def test_census_2022(spark, root):
    paths = domain.census_2022_files(root / "b")
    files = {k: read_delimited(spark, p) for k, p in paths.items()}
    rows = {r[vocab.UNIT_COLUMN]: r for r in census_2022(**files).collect()}
    assert set(rows) == {"centro", "agua verde", "batel", "cidade industrial"}
    c = rows["centro"]
    assert (c["populacao_2022"], c["resp_domicilios_particulares_2022"]) == (2500, 650)
    assert c["rendimento_medio_responsavel_sm_2022"] == pytest.approx(3.0)
    # "1.000" is a plain number here: separators are kept in literacy cells.
    assert c["alfabetizados_15mais_2022"] == pytest.approx(12 * 99 + 1)
    assert c["domicilios_particulares_permanentemente_ocupados_2022"] == 1000
    assert c["esgotamento_precario_2022"] == 16 and c["pct_esgotamento_precario_2022"] == pytest.approx(1.6)
    assert c["domicilios_improvisados_estrutura_degradada_2022"] == 5
    doubled = {**files, "dom1": files["dom1"].unionByName(files["dom1"])}
    with pytest.raises(Exception, match="not unique"):
        census_2022(**doubled).collect()


def test_interpolation_hits_both_anchors(spark):
    df = spark.createDataFrame([("a", 10.0, 34.0), ("b", None, 3.0)], "u string, x_2010 double, x_2022 double")
    rows = {(r["u"], r["ano"]): r for r in interpolate_years(df, "u", ["x"]).collect()}
    assert len(rows) == 36
    assert [rows["a", y]["x_estimado"] for y in (2009, 2010, 2016, 2022, 2026)] == [8.0, 10.0, 22.0, 34.0, 42.0]
    assert [rows["a", y]["tipo_estimativa"] for y in (2009, 2010, 2011, 2022, 2023)] == ["extrapolado", "observado", "interpolado", "observado", "extrapolado"]
    assert rows["b", 2010]["x_estimado"] is None


def test_consistency_edge_rules(spark):
    names = ["populacao", "resp_domicilios_particulares", "rendimento_medio_responsavel_sm", "pop_15mais", "alfabetizados_15mais", "domicilios_particulares_ocupados",
             "sem_banheiro_sanitario", "esgotamento_precario", "sem_rede_geral_agua", "lixo_destino_inadequado"]
    schema = "ano int, rate double, " + ", ".join(f"{n}_estimado double" for n in names)
    rows = [
        (2015, 90.0, 10.5, 11.5, 1.005, 100.0, 120.0, 50.0, -1.0, 60.0, None, 10.0),
        (2025, 90.0, 10.0, 10.0, 1.0, 200.0, 10.0, -3.0, 1.0, 1.0, 1.0, 1.0),
        (2015, 90.0, 10.0, 10.0, 1.0, 0.0, 0.0, 10.0, 1.0, 1.0, 1.0, 1.0),
    ]
    a, b, c = apply_consistency(spark.createDataFrame(rows, schema), "ano", "rate").collect()
    assert (a["populacao_estimado"], a["resp_domicilios_particulares_estimado"]) == (10, 12)
    assert (a["pct_alfabetizacao_15mais_estimado"], a["alfabetizados_15mais_estimado"], a["analfabetos_15mais_estimado"]) == (100.0, 100, 0)
    assert (a["sem_banheiro_sanitario_estimado"], a["esgotamento_precario_estimado"]) == (0, 50)
    # A missing count becomes the household count.
    assert (a["sem_rede_geral_agua_estimado"], a["pct_sem_rede_geral_agua_estimado"]) == (50, 100.0)
    assert (b["pct_alfabetizacao_15mais_estimado"], b["alfabetizados_15mais_estimado"]) == (90.0, 180)
    assert b["domicilios_particulares_ocupados_estimado"] == 0 and b["pct_esgotamento_precario_estimado"] is None
    assert c["pct_alfabetizacao_15mais_estimado"] is None and c["pct_analfabetismo_15mais_estimado"] is None


def test_attach_keeps_rows_and_checks_keys(spark):
    inc = spark.createDataFrame([("a", 2010), ("a", 2010), ("b", 2011), (None, 2010)], "u string, y int")
    yearly = spark.createDataFrame([("a", 2010, 1.0)], "u string, ano int, v double")
    assert sorted(str(r["v"]) for r in attach_yearly(inc, yearly, "u", "y").collect()) == ["1.0", "1.0", "None", "None"]
    with pytest.raises(Exception, match="not unique"):
        attach_yearly(inc, yearly.unionByName(yearly), "u", "y").collect()
    with pytest.raises(Exception, match="left side is not unique"):
        checked_join(inc, yearly, ["u"], "inner", "1:1").collect()


def test_jobs_end_to_end(spark, root, incidents, yearly):
    assert yearly.count() == 4 * 18
    assert key_difference(incidents.select(vocab.UNIT_COLUMN), yearly.select(vocab.UNIT_COLUMN), [vocab.UNIT_COLUMN]).count() == 0
    features = build_index(incidents, yearly, str(root / "index"))
    assert features.count() == incidents.count()
    low, high = features.agg(F.min("IQV_final"), F.max("IQV_final")).first()
    assert 0 <= low < high <= 100
    assert "OUTROS" in features.columns and not set(vocab.POOLED_CATEGORIES) & set(features.columns)

    panel, model = build_panel(features)
    assert panel.count() == 4 * 72 * 6
    for c in vocab.FORECAST_CATEGORIES:
        assert panel.where(F.col("categoria") == c).agg(F.sum("y")).first()[0] == features.agg(F.sum(c)).first()[0]
    assert model.where(F.col("lag_12").isNull()).count() == 0
    gold = model_features_table(model.dropna(subset=["IQV", "log_pop"]))
    assert len(gold.columns) == 7 + 22 and all(r["violations"] == 0 for r in table_violations(gold, "model_features_contagem_mensal").collect())
    iqv = index_by_year(features.dropna(subset=["IQV_final"]), vocab.UNIT_COLUMN)
    assert all(r["violations"] == 0 for r in table_violations(iqv, "bairro_iqv_anual").collect())
    assert unit_dimension(features, vocab.UNIT_COLUMN).count() == 4
    facts, census, annual = incident_facts(incidents), census_table(yearly), yearly_table(yearly)
    assert facts.count() == sum(incidents.agg(*[F.sum(c) for c in vocab.NATURE_CATEGORIES]).first()) and census.count() == 4 * 2 and annual.count() == 4 * 18
    units = unit_dimension(incidents, vocab.UNIT_COLUMN)
    for table in (facts, census, annual):
        assert fk_orphans(table, units, "bairro_id", "id").count() == 0
    values = [c for c in census.columns if c.startswith(("log_", "pct_"))]
    assert all(r["violations"] == 0 for r in table_violations(census, "ibge_bairro_censo", values).collect())
    assert all(r["violations"] == 0 for r in table_violations(annual, "bairro_indicadores_anuais", values).collect())
    assert all(r["violations"] == 0 for r in table_violations(facts, "ocorrencias").collect())
    assert category_dimension(features, vocab.FORECAST_CATEGORIES).where("ativa").count() == 6


def test_map_join(spark, tmp_path):
    (tmp_path / "map.json").write_text(
        '{"type": "FeatureCollection", "features": ['
        '{"type": "Feature", "properties": {"nome": "ALTO DA RUA XV", "x": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}},'
        '{"type": "Feature", "properties": {"nome": "Nowhere"}, "geometry": null}]}'
    )
    polygons = read_geojson(spark, str(tmp_path / "map.json"), ["nome"])
    data = spark.createDataFrame([("alto da xv", 2020, 10.0), ("alto da xv", 2020, 30.0), ("alto da xv", 2021, 40.0)], "u string, ano int, IQV_final double")
    means = unit_means(data, "u", "ano", ["IQV_final"])
    rows = {r["nome"]: r for r in map_indicators(polygons, means).collect()}
    assert rows["ALTO DA RUA XV"]["IQV_final"] == 30.0 and "Point" in rows["ALTO DA RUA XV"]["geometry"]
    classes = {r["nome"]: r["IQV_categoria"] for r in map_classes(polygons, means).collect()}
    assert classes == {"ALTO DA RUA XV": "IQV baixo", "Nowhere": "Sem dados"}
    assert math.isfinite(rows["ALTO DA RUA XV"]["IQV_final"])
