"""Map polygons with their mean indicators, joined on the normalised name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.text import normalize_name
from ..operators.aggregates import two_level_mean
from .index import quantile_class


def unit_means(df: DataFrame, unit: str, year: str, cols: Sequence[str]) -> DataFrame:
    """Year-balanced means per normalised unit name."""
    named = df.withColumn("bairro_join", normalize_name(F.col(unit), vocab.MAP_UNIT_ALIASES))
    return two_level_mean(named, "bairro_join", year, cols)


def map_indicators(polygons: DataFrame, means: DataFrame, name: str = "nome") -> DataFrame:
    """Every polygon, with indicators where the name is known."""
    named = polygons.withColumn("bairro_join", normalize_name(F.col(name), vocab.MAP_UNIT_ALIASES))
    return named.join(means, "bairro_join", "left")


def map_classes(polygons: DataFrame, means: DataFrame, index: str = "IQV_final", name: str = "nome") -> DataFrame:
    """Polygons with their inclusive quartile class; no index gives ``Sem dados``."""
    return quantile_class(map_indicators(polygons, means, name), index, out="IQV_categoria")
