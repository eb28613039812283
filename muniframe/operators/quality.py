"""Constraint checks over batch tables, each in one pass where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): rows where a rule is false. Null passes, as in SQL CHECK."""
    counted = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(True))).alias(name) for name, cond in rules.items()])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
    return counted.select(F.inline(F.array(*pairs)))


def not_null_rules(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{c} not null": F.col(c).isNotNull() for c in cols}


def range_rules(ranges: Mapping[str, tuple[object, object]]) -> dict[str, Column]:
    """``{column: (low, high)}`` with ``None`` for an open end."""
    rules = {}
    for c, (lo, hi) in ranges.items():
        tests = ([F.col(c) >= lo] if lo is not None else []) + ([F.col(c) <= hi] if hi is not None else [])
        rules[f"{c} between {lo} and {hi}"] = reduce(lambda x, y: x & y, tests)
    return rules


# Rules of the relational target schema, as written there.
LITERAL_RULES = {
    "occurrence": {"ocorrencia_mes": (1, 12), "ocorrencia_dia_semana": (1, 12)},
    "index": {"iqv": (0, 100)},
    "panel": {
        "mes": (1, 12), "y": (0, None), "iqv": (0, 100),
        "lag_1": (0, None), "lag_2": (0, None), "lag_3": (0, None), "lag_6": (0, None), "lag_12": (0, None),
        "media_3": (0, None), "media_6": (0, None), "media_12": (0, None),
    },
}
LITERAL_CENSUS_YEARS = (2009, 2026)
# What the data really hold: weekday 0-7 (0 is unknown) and the two census years.
CORRECTED_RULES = {**LITERAL_RULES, "occurrence": {"ocorrencia_mes": (1, 12), "ocorrencia_dia_semana": (0, 7)}}
CORRECTED_CENSUS_YEARS = (2010, 2022)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct non-null child keys without a parent, with their row count.

    The child is counted per key before the join, so a hot key moves as one row.
    """
    counts = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


#: Categories listed per value, the first in order; all of them are counted.
LISTED = 100


def overlapping_values(vocabulary: DataFrame, value: str, category: str) -> DataFrame:
    """Values under more than one category, with the number of categories and the first LISTED of them."""
    pairs = vocabulary.select(value, category).dropna().distinct()
    counts = pairs.groupBy(value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    order = Window.partitionBy(value).orderBy(category)
    first = pairs.join(counts, value).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= LISTED)
    return first.groupBy(value, "n").agg(F.sort_array(F.collect_list(category)).alias("categories")).select(value, "n", "categories")


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill nulls (or add missing columns) with a default literal or Column."""
    out = {}
    for c, v in defaults.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out[c] = F.coalesce(F.col(c), value) if c in df.columns else value
    return df.withColumns(out)


def require_rows(df: DataFrame, expected: int, label: str = "table") -> DataFrame:
    """Raise unless the frame has exactly ``expected`` rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{label} has {found} rows, expected {expected}")
    return df
