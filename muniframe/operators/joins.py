"""Joins with declared cardinality, profiles and key comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their count. Only keys are moved, counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], label: str = "join side") -> DataFrame:
    """The same rows, untouched; any job over them fails when a key repeats. Rows without a key count as one key.

    Rows are counted where they lie after the exchange and sort by key that a join on these keys needs as well, so nothing is read or moved twice.
    """
    message = F.concat(F.lit(f"{label} is not unique on {list(keys)}: "), F.to_json(F.struct(*keys)))
    counted = df.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.assert_true(F.col("__same") == 1, message).isNull()).drop("__same")


def checked_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "1:1") -> DataFrame:
    """Equi-join that fails when ``validate`` (``1:1``, ``m:1``, ``1:m``) does not hold."""
    left, right = validate.split(":")
    if left == "1":
        a = require_unique(a, on, "left side")
    if right == "1":
        b = require_unique(b, on, "right side")
    return a.join(b, list(on), how)


def suffix_columns(df: DataFrame, suffix: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add a suffix to every column that is neither a key nor already suffixed."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys and not c.endswith(suffix)})


def outer_profile(frames: Sequence[DataFrame], on: Sequence[str], suffix: str = "") -> DataFrame:
    """One row per key of any of the frames with the columns of all: what a chain of full-outer 1:1 joins gives, by one union and one aggregate.

    Fails when a key repeats in a frame. Columns besides ``on`` must differ between the frames; rows without a key meet as one key."""
    tagged = [f.withColumn("__frame", F.lit(k)) for k, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for f in frames for c in f.columns if c not in on]
    if len(set(columns)) < len(columns):
        raise ValueError(f"columns in more than one frame: {sorted(c for c in set(columns) if columns.count(c) > 1)}")
    rows = [F.count_if(F.col("__frame") == k) for k in range(len(frames))]
    wide = every.groupBy(*on).agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in columns], F.greatest(F.lit(0), *rows).alias("__same"))
    message = F.concat(F.lit(f"a frame is not unique on {list(on)}: "), F.to_json(F.struct(*on)))
    wide = wide.where(F.assert_true(F.col("__same") <= 1, message).isNull()).drop("__same")
    return suffix_columns(wide, suffix, on) if suffix else wide


def key_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys found on one side only, tagged ``left`` / ``right``; empty means equal domains."""
    ka, kb = a.select(*on).distinct(), b.select(*on).distinct()
    left = ka.join(kb, list(on), "left_anti").withColumn("side", F.lit("left"))
    right = kb.join(ka, list(on), "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def common_keys(a: DataFrame, b: DataFrame, key: str, where=None) -> DataFrame:
    """Distinct trimmed keys present in both frames, optionally after one filter on each."""
    if where is not None:
        a, b = a.where(where), b.where(where)
    trimmed = F.trim(F.col(key).cast("string")).alias(key)
    return a.select(trimmed).dropna().intersect(b.select(trimmed).dropna())


def union_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def gain_table(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str], metrics: Sequence[str]) -> DataFrame:
    """Compare two summaries: absolute and relative gain of ``a`` over ``b`` per metric."""
    left, right = suffix_columns(a, suffixes[0], on), suffix_columns(b, suffixes[1], on)
    joined = left.join(right, list(on))
    gains: Mapping = {}
    for m in metrics:
        diff = F.col(m + suffixes[1]) - F.col(m + suffixes[0])
        gains = {**gains, f"gain_{m}_abs": diff, f"gain_{m}_pct": diff / F.nullif(F.col(m + suffixes[1]), F.lit(0.0))}
    return joined.withColumns(gains)
