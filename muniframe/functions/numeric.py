"""Number parsing, guarded ratios, clipping and rounding."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\r\n"


def to_number(c: Column) -> Column:
    """Lenient cast: plain decimal notation or null.

    The cast also takes ``inf``, ``nan``, ``1d`` and hexadecimal; a plain number ends in
    a digit or a point and has no ``x``, which is cheaper to test than a pattern.
    """
    last = F.right(F.rtrim(c, F.lit(BLANKS)), F.lit(1))
    plain = last.between("0", "9") | (last == ".")
    return F.when(plain & ~F.contains(F.lower(c), F.lit("x")), c.try_cast("double"))


def parse_census_number(c: Column, null_tokens: Iterable[str] = ("X", "", "nan")) -> Column:
    """Trim, drop suppression tokens, decimal comma to point, cast."""
    text = F.trim(c)
    return F.when(~text.isin(*null_tokens), to_number(F.replace(text, F.lit(","), F.lit("."))))


def parse_ptbr_number(c: Column) -> Column:
    """``1.234,56`` -> 1234.56."""
    plain = F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return to_number(plain)


def strict_long(c: Column, name: str = "value") -> Column:
    """Lenient parse followed by a hard failure on null, as an integer column must be whole."""
    value = to_number(c.cast("string"))
    failed = F.raise_error(F.concat(F.lit(f"column {name} is not numeric: "), F.coalesce(c.cast("string"), F.lit("NULL"))))
    return F.when(value.isNull(), failed.cast("bigint")).otherwise(value.cast("bigint"))


def cast_columns(df: DataFrame, whole: Iterable[str] = (), doubles: Iterable[str] = ()) -> DataFrame:
    """Text columns to typed ones: ``whole`` must be complete, ``doubles`` turn bad values into null."""
    return df.withColumns({**{c: strict_long(F.col(c), c) for c in whole}, **{c: to_number(F.col(c).cast("string")) for c in doubles}})


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def pct(num: Column, den: Column) -> Column:
    return ratio(num.cast("double"), den) * 100


def rate_per(num: Column, pop: Column, k: int = 10_000) -> Column:
    return ratio(num.cast("double"), pop) * k


def positive_ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is positive, else null."""
    return F.when(den > 0, num / den)


def clip(c: Column, lo: object = None, hi: object = None) -> Column:
    """Null stays null (``greatest`` would skip it)."""
    out = c
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def keep_or(c: Column, cond: Column, other: Column) -> Column:
    """Keep ``c`` where ``cond`` holds; a null condition takes ``other``."""
    return F.when(cond, c).otherwise(other)


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Scale, round half to even, scale back."""
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def row_sum(*cols: Column) -> Column:
    """Sum across columns with nulls skipped (0 when all are null)."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def array_sum(values: Column) -> Column:
    """Sum of an array with nulls skipped (0 when all are null)."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def row_mean(*cols: Column) -> Column:
    """Mean across columns with nulls skipped, null when all are null."""
    count = F.lit(0)
    for c in cols:
        count = count + c.isNotNull().cast("int")
    return ratio(row_sum(*cols), count)


def any_positive(*cols: Column) -> Column:
    """1 when any flag is set, else 0."""
    return (F.coalesce(F.greatest(*cols, F.lit(0)), F.lit(0)) > 0).cast("int")


def argmax_name(names: Iterable[str]) -> Column:
    """Name of the first column holding the row maximum; all-zero gives the first."""
    names = list(names)
    filled = {n: F.coalesce(F.col(n), F.lit(0)) for n in names}
    top = F.greatest(*filled.values()) if len(names) > 1 else filled[names[0]]
    return F.coalesce(*[F.when(filled[n] == top, F.lit(n)) for n in names])


def cyclic(month: Column, harmonic: int) -> tuple[Column, Column]:
    angle = month * (2 * math.pi * harmonic / 12)
    return F.sin(angle), F.cos(angle)
