"""The three end-to-end jobs: incidents, yearly indicators and index, monthly panel.

Stages hand over Parquet tables, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions.dates import month_start
from ..functions.numeric import cast_columns
from ..sources.files import UTF8, read_delimited, write_delimited
from .census import census_2010, census_2022
from .incidents import clean_incidents, unify_incidents
from .index import index_features
from .indicators import attach_yearly, yearly_indicators
from .panel import add_unit_year_features, dense_panel, model_features, monthly_flag_counts, naive_baselines, temporal_features


def clean_incident_files(spark: SparkSession, old: str, new: str, out: str, csv: str | None = None) -> DataFrame:
    """Two raw extracts to one cleaned incident table (and an interchange CSV on request)."""
    unified = unify_incidents(read_delimited(spark, old, ";"), read_delimited(spark, new, ","))
    clean_incidents(unified).write.mode("overwrite").parquet(out)
    cleaned = spark.read.parquet(out)
    if csv:
        write_delimited(cleaned, csv, ";", UTF8)
    return cleaned


def build_yearly(spark: SparkSession, files_2010: Mapping[str, str], files_2022: Mapping[str, str], out: str, municipality: str = vocab.MUNICIPALITY_CODE) -> DataFrame:
    """Census files (paths by parameter name of the census functions) to yearly indicators."""
    c10 = census_2010(**{k: read_delimited(spark, p) for k, p in files_2010.items()}, municipality=municipality)
    c22 = census_2022(**{k: read_delimited(spark, p) for k, p in files_2022.items()}, municipality=municipality)
    yearly_indicators(c10, c22).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def build_index(incidents: DataFrame, yearly: DataFrame, out: str) -> DataFrame:
    """Incidents with indicators, pooled class, logs, norms and index.

    The joined table is staged, because normalisation reads it twice.
    """
    spark = incidents.sparkSession
    attach_yearly(incidents, yearly, vocab.UNIT_COLUMN, "OCORRENCIA_ANO").write.mode("overwrite").parquet(f"{out}/attached")
    attached = cast_columns(spark.read.parquet(f"{out}/attached"), ["OCORRENCIA_MES", "OCORRENCIA_DIA", *vocab.NATURE_CATEGORIES])
    index_features(attached, vocab.POOLED_CATEGORIES).write.mode("overwrite").parquet(f"{out}/features")
    return spark.read.parquet(f"{out}/features")


def build_panel(features: DataFrame, fill: str = "parity") -> tuple[DataFrame, DataFrame]:
    """(panel with naive forecasts, model features) from the incident feature table."""
    dated = features.withColumn("data", month_start(F.col("ano"), F.col("OCORRENCIA_MES")))
    counts = monthly_flag_counts(dated, vocab.UNIT_COLUMN, "data", vocab.FORECAST_CATEGORIES)
    per_year = features.groupBy(F.col(vocab.UNIT_COLUMN).alias("unit"), "ano").agg(F.avg("log_pop").alias("log_pop"), F.avg("IQV_final").alias("IQV"))
    dense = add_unit_year_features(dense_panel(counts, vocab.FORECAST_CATEGORIES), per_year, ["log_pop", "IQV"], fill)
    history = temporal_features(dense)
    return naive_baselines(history), model_features(history)
