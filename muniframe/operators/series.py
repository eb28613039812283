"""Lags and moving means over (unit, category) monthly series.

A series is one calendar grid, so a window partition is bounded by the number of
months whatever the size of the event table. All columns share one window
specification and therefore one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .ordering import fill_from_next


def add_lags(df: DataFrame, keys: Sequence[str], order: str, y: str, lags: Sequence[int] = (1, 2, 3, 6, 12)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in lags})


def add_moving_means(
    df: DataFrame, keys: Sequence[str], order: str, y: str, windows: Sequence[int] = (3, 6, 12), history: str | None = "media_historica"
) -> DataFrame:
    """Means of the previous k rows (current row left out, short windows allowed) and of all previous rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    cols = {f"media_{k}": F.avg(y).over(w.rowsBetween(-k, -1)) for k in windows}
    if history:
        cols[history] = F.avg(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns(cols)


def fill_panel(
    df: DataFrame, unit: str, category: str, date: str, cols: Sequence[str], mode: str = "parity"
) -> DataFrame:
    """Forward fill per unit, then backward fill.

    ``parity``: forward in (category, date) order per unit, then backward over the
    whole frame sorted by (unit, category, date), so a unit without any value takes
    the next unit's first value. ``time``: per (unit, category) in date order only, forward
    then backward, so nothing crosses a series.
    """
    keys, order = ([unit, category], [date]) if mode == "time" else ([unit], [category, date])
    # The next value is the last one of the reversed order, so both frames grow from the start of the partition.
    forward = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(forward), F.last(c, ignorenulls=True).over(backward)) for c in cols})
    if mode == "time":
        return filled
    # After the in-unit passes a null is left only where a unit has no value at all.
    firsts = df.groupBy(unit).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(category, date))).alias(c) for c in cols]
    )
    carried = fill_from_next(firsts, [unit], cols).withColumnsRenamed({c: f"__unit_{c}" for c in cols})
    joined = filled.join(carried, unit, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__unit_{c}")) for c in cols}).drop(*[f"__unit_{c}" for c in cols])
