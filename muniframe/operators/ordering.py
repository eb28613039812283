"""Global order without a single-task window.

Row numbers, running totals, ranks and exact quantiles are built from one range
sort. The sorted frame is checkpointed, so the partition and position of each row
are fixed facts that later stages (and retries) agree on. What is carried between
partitions is one total per (partition, group): bounded by the partition count,
never by the data. A group holding a third of all rows is spread over a third of
the partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed, stored

PART, POS = "__part", "__pos"


def _as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort by (by, order), tag rows with partition and position, fix the result."""
    ordered = df.orderBy(*[F.col(b) for b in by], *_as_columns(order))
    tagged = ordered.withColumn(POS, F.monotonically_increasing_id())
    return checkpointed(tagged).withColumn(PART, F.shiftright(POS, 33))


def _carried(keyed: DataFrame, by: Sequence[str], total: Column) -> DataFrame:
    """Per (partition, group): first position, total of earlier partitions, total of the group."""
    segments = keyed.groupBy(PART, *by).agg(F.min(POS).alias("__first"), total.alias("__sum"))
    # At most one row per partition and group enters these windows.
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__sum").over(earlier), F.lit(0))
    return segments.withColumns({"__before": before, "__total": F.sum("__sum").over(Window.partitionBy(*by))}).drop("__sum")


def _join_segments(keyed: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    renamed = segments.withColumnsRenamed({PART: "__s_part", **{b: f"__s_{b}" for b in by}})
    cond = F.col(PART) == F.col("__s_part")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__s_{b}"))
    return keyed.join(renamed, cond).drop("__s_part", *[f"__s_{b}" for b in by])


def number_rows(
    df: DataFrame, order: Sequence[str | Column], out: str = "row_number", by: Sequence[str] = (), size: str | None = None
) -> DataFrame:
    """1-based row number per ``by`` group, and on request the group size.

    ``order`` must be a total order to be reproducible.
    """
    keyed = range_sorted(df, by, order)
    joined = _join_segments(keyed, _carried(keyed, by, F.count(F.lit(1))), by)
    number = F.col(POS) - F.col("__first") + F.col("__before") + 1
    added = {out: number.cast("bigint"), **({size: F.col("__total")} if size else {})}
    return joined.withColumns(added).drop(PART, POS, "__first", "__before", "__total")


def numbered_as_stored(df: DataFrame, out: str) -> DataFrame:
    """The same rows, stored, with numbers from 0 without gaps, in no particular order: no sort, only a count per stored partition."""
    fixed = stored(df.withColumn(POS, F.monotonically_increasing_id())).withColumn(PART, F.shiftright(POS, 33))
    sizes = fixed.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition enters this window.
    before = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col(PART).alias("__s_part"), before.alias("__before"))
    joined = fixed.join(F.broadcast(firsts), F.col(PART) == F.col("__s_part"))
    return joined.withColumn(out, F.col("__before") + F.col(POS).bitwiseAND((1 << 33) - 1)).drop(PART, POS, "__s_part", "__before")


#: Rounds of the network.
ROUNDS = 4
#: Primes of the 64-bit xxHash.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash64(seed: np.ndarray | np.uint64, value: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of whole numbers, given the hash of the columns before."""
    if value.dtype == np.int64:
        h = _turned((seed + P5 + np.uint64(8)) ^ (_turned(value.view(np.uint64) * P2, 31) * P1), 27) * P1 + P4
    else:
        h = _turned((seed + P5 + np.uint64(4)) ^ (value.astype(np.int32).view(np.uint32).astype(np.uint64) * P1), 23) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _network(x: np.ndarray, low: np.ndarray, high: np.ndarray, key: Sequence[np.ndarray]) -> np.ndarray:
    """One pass of the Feistel network over the ``low`` and ``high`` bits of each number."""
    mask_low, mask_high = (1 << low) - 1, (1 << high) - 1
    left, right = x >> low, x & mask_low

    def mixed(half: np.ndarray, turn: int, side: int) -> np.ndarray:
        parts = [np.full(1, turn, np.int32), np.full(1, side, np.int32), *key]
        return reduce(_xxhash64, parts, _xxhash64(np.uint64(42), half)).view(np.int64)

    for turn in range(1, ROUNDS + 1):
        left = left ^ (mixed(right, turn, 0) & mask_high)
        right = right ^ (mixed(left, turn, 1) & mask_low)
    return (left << low) + right


def _shuffled(number: pd.Series, size: pd.Series, *key: pd.Series) -> pd.Series:
    if not len(number):
        return number
    if any(k.dtype.kind not in "ib" for k in key):
        raise TypeError("the key of a bijection is made of whole numbers without nulls")
    x, most, keys = number.to_numpy(np.int64), size.to_numpy(np.int64), [k.to_numpy() for k in key]
    keys = [k[:1] if (k == k[0]).all() else k for k in keys]
    bits = np.maximum(np.ceil(np.log2(np.maximum(most, 2))).astype(np.int64), 2)
    low = bits // 2
    out = _network(x, low, bits - low, keys)
    while len(again := np.flatnonzero(out >= most)):
        out[again] = _network(out[again], low[again], (bits - low)[again], [k if len(k) == 1 else k[again] for k in keys])
    return pd.Series(out)


def shuffled_number(number: Column, size: Column, *key: Column) -> Column:
    """Another number below ``size`` for each of 0 .. size - 1, a bijection chosen by ``key`` (whole numbers): a Feistel network on the bits of size - 1,
    walked until the number is inside again. No sort and no state: every row works out its own, many at a time in numpy."""
    return F.pandas_udf(_shuffled, "bigint")(number.cast("bigint"), size.cast("bigint"), *key)


def running_sum(
    df: DataFrame, order: Sequence[str | Column], value: str, out: str, by: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """Inclusive running total of ``value`` per ``by`` group, and on request the group total."""
    keyed = range_sorted(df, by, order)
    joined = _join_segments(keyed, _carried(keyed, by, F.sum(value)), by)
    # One range partition of one group per window partition.
    inside = Window.partitionBy(PART, *by).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    added = {out: F.sum(value).over(inside) + F.col("__before"), **({total: F.col("__total")} if total else {})}
    return joined.withColumns(added).drop(PART, POS, "__first", "__before", "__total")


def rank_min(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Competition rank (ties share the lowest number) per ``by`` group.

    Ties collapse before the sort, so a value shared by many rows costs one row.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    key = F.col(value).desc() if descending else F.col(value).asc()
    cumulative = running_sum(counts, [key], "__n", "__cum", by)
    ranks = cumulative.select(*by, value, (F.col("__cum") - F.col("__n") + 1).cast("bigint").alias(out))
    return df.join(ranks, [*by, value])


def fill_from_next(df: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the next non-null value in a global order."""
    keyed = range_sorted(df, (), order)
    # Walking backwards, the next value is the last one seen: a growing frame, not one that is read anew for every row.
    following = Window.partitionBy(PART).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    firsts = keyed.groupBy(PART).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(POS))).alias(c) for c in cols])
    # One row per partition; the value to carry back is the first one found in later partitions.
    later = Window.orderBy("__s_part").rowsBetween(1, Window.unboundedFollowing)
    carry = firsts.withColumnRenamed(PART, "__s_part")
    carry = carry.select("__s_part", *[F.first(c, ignorenulls=True).over(later).alias(f"__next_{c}") for c in cols])
    joined = keyed.join(carry, F.col(PART) == F.col("__s_part"))
    filled = joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(following), F.col(f"__next_{c}")) for c in cols})
    return filled.select(*df.columns)


#: Precision of the sketch that brackets a quantile, and how many of its errors the bracket spans to either side.
SKETCH, MARGIN = 10_000, 4
#: Distinct values inside the brackets of one group that one task may sort.
INSIDE = 2_000_000
#: Groups whose brackets are sent to every executor, so that the rows of a group stay where they are; beyond, rows and brackets meet by a shuffle.
BROADCAST_GROUPS = 10_000


def exact_quantiles(
    df: DataFrame, col: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles, one output column per ``probs`` entry; nulls and NaN are left out.

    Selection instead of a sort: a sketch per group brackets each wanted position, one more pass counts the rows between the brackets
    and each value inside them, and only these few values are ordered. Rows are neither sorted nor stored. Where a bracket misses, or holds
    too many values for one task, the values are sorted by range instead.
    """
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, F.col(col).cast("double").alias("__v"))
    room = MARGIN / SKETCH
    shares = [min(1.0, max(0.0, p + side * room)) for p in probs.values() for side in (-1, 1)]
    sketch = values.groupBy(*by).agg(F.percentile_approx("__v", F.array(*map(F.lit, shares)), SKETCH).alias("__edges"))
    if by:
        edges = stored(sketch.withColumnsRenamed({b: f"__s_{b}" for b in by}))
        if edges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
            edges = F.broadcast(edges)
        same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__s_{b}")) for b in by])
        values = values.join(edges, same).select(*by, "__v", "__edges")
    else:
        values = values.withColumn("__edges", sketch.scalar())
    v, edge = F.col("__v"), lambda k: F.get("__edges", F.lit(k))
    inside = reduce(lambda x, y: x | y, [v.between(edge(2 * k), edge(2 * k + 1)) for k in range(len(probs))])
    # A row outside goes by the last edge below it: between that bracket and the next, all rows are one count.
    last = F.greatest(*[F.when(edge(2 * k + 1) < v, edge(2 * k + 1)).otherwise(F.lit(float("-inf"))) for k in range(len(probs))], F.lit(float("-inf")))
    counts = stored(
        values.select(*by, inside.alias("__in"), F.when(inside, v).otherwise(last).alias("__v")).groupBy(*by, "__in", "__v").agg(F.count(F.lit(1)).alias("__n"))
    )
    most = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0]
    if (most or 0) > INSIDE:
        return _sorted_quantiles(df, col, probs, by)
    upto = Window.partitionBy(*by).orderBy("__v", F.col("__in").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"__cum": F.sum("__n").over(upto), "__count": F.sum("__n").over(Window.partitionBy(*by))})
    found = stored(_at_positions(placed.withColumn("__v", F.when(F.col("__in"), F.col("__v"))), probs, by))
    missed = reduce(lambda x, y: x | y, [F.col(name).isNull() for name in probs])
    return _sorted_quantiles(df, col, probs, by) if found.where(missed).limit(1).count() else found


#: Buckets per standard deviation, and the buckets and the values inside one that are looked at outside of Spark.
STEP, BUCKETS, LOOKED_AT = 1024, 1_000_000, 200_000


def bucket_counts(df: DataFrame, cols: Sequence[str]) -> pd.DataFrame | None:
    """How many values of each column lie in buckets of equal width: column (its place in ``cols``), bucket, n, and the least and greatest value in it, in
    their order. Nulls and NaN are left out. A bucket is a fixed share of the standard deviation, so few values are far enough out to have buckets of their
    own; None where they are too many."""
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    shape = df.agg(*[F.struct(F.avg(v), F.stddev_pop(v)).alias(f"s{i}") for i, v in enumerate(values)]).first()
    pairs = []
    for i, v in enumerate(values):
        mean, spread = (x or 0.0 for x in shape[i])
        by = STEP / spread if spread else 0.0
        if not np.isfinite([mean, spread, by]).all():
            return None
        bucket = F.floor(F.greatest(F.least((v - mean) * by, F.lit(1e15)), F.lit(-1e15)))
        pairs.append(F.struct(F.lit(i).alias("column"), bucket.alias("bucket"), v.alias("v")))
    long = df.select(F.inline(F.array(*pairs))).where("v is not null")
    counted = stored(long.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    if counted.limit(BUCKETS + 1).count() > BUCKETS:
        return None
    return pd.DataFrame({f: c.to_numpy() for f, c in zip(counted.columns, counted.toArrow().columns)}).sort_values(["column", "bucket"], ignore_index=True)


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The median of each column that has values, exact: buckets tell in which one it lies, and only its values are counted."""
    buckets = bucket_counts(df, cols)
    wanted = []
    for i, c in enumerate(cols) if buckets is not None else ():
        own = buckets[buckets["column"] == i]
        upto = own["n"].cumsum().to_numpy()
        if len(own):
            places = [(upto[-1] - 1) // 2, upto[-1] // 2]
            first, last = np.searchsorted(upto, places, side="right")
            wanted.append((i, c, float(own["lo"].iloc[first]), float(own["hi"].iloc[last]), upto[first] - own["n"].iloc[first], places))
    if wanted:
        value = {c: F.col(c).cast("double") for c in cols}
        ranges = [F.when(value[c].between(lo, hi), F.struct(F.lit(i).alias("column"), value[c].alias("v"))) for i, c, lo, hi, *_ in wanted]
        inside = stored(df.select(F.inline(F.array_compact(F.array(*ranges)))).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
        if inside.limit(LOOKED_AT + 1).count() <= LOOKED_AT:
            rows = inside.collect()
            found = {}
            for i, c, _, _, before, places in wanted:
                own = sorted((r["v"], r["n"]) for r in rows if r["column"] == i)
                low, high = (own[k][0] for k in np.searchsorted(np.cumsum([n for _, n in own]) + before, places, side="right"))
                found[c] = low + (high - low) * 0.5
            return found
    elif buckets is not None:
        return {}
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return {r["column"]: r["median"] for r in exact_quantiles(long, "value", {"median": 0.5}, by=["column"]).collect()}


def _at_positions(placed: DataFrame, probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Quantiles from values (``__v``) with their count (``__n``), running count (``__cum``) and the group's count (``__count``)."""
    start = F.col("__cum") - F.col("__n")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("__cum")), F.col("__v")))

    aggs = []
    for name, p in probs.items():
        exact = (F.col("__count") - 1) * F.lit(float(p))
        low, high = F.floor(exact), F.ceil(exact)
        aggs += [at(low).alias(f"{name}__lo"), at(high).alias(f"{name}__hi"), F.max(exact - low).alias(f"{name}__w")]
    found = placed.groupBy(*by).agg(*aggs)
    blend = [
        (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__w")).alias(n) for n in probs
    ]
    return found.select(*by, *blend)


def _sorted_quantiles(df: DataFrame, col: str, probs: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Equal values collapse to a count; the running count along one range sort then tells which value sits at a wanted position."""
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    counts = values.groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return _at_positions(running_sum(counts, ["__v"], "__n", "__cum", by, total="__count"), probs, by)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Best ``k`` rows (a TakeOrdered plan: k rows per task, then a merge)."""
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group as a map-side combined aggregate, not a window."""
    rest = [c for c in df.columns if c not in group]
    keys = F.struct(*_as_columns(order))
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), keys).alias("__row"))
    return best.select(*group, "__row.*")
