"""Literal dictionary lookups for small vocabularies (under about 100 entries)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def literal_map(mapping: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(c: Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """``mapping[c]``; a missing key gives ``default`` (a Column or a literal)."""
    if not mapping:
        return default if isinstance(default, Column) else F.lit(default)
    found = F.try_element_at(literal_map(mapping), c)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace mapped values, keep the rest. One pass, so replacements do not chain."""
    return lookup(c, mapping, default=c)


def vocabulary_frame(spark: SparkSession, mapping: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A dictionary as a two-column DataFrame; its size is that of the Python dict."""
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} string")
