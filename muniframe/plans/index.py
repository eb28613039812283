"""Composite quality-of-life index: normalisation, weights, sensitivity, ranking, classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import any_positive, row_mean
from ..operators.aggregates import bounds, mean_by
from ..operators.ordering import exact_quantiles, number_rows, rank_min

SCORE_DIGITS = 9

# Final weights of the index.
FINAL_WEIGHTS = {
    "rendimento_medio_responsavel_sm_estimado_norm": 1 / 3,
    "pct_alfabetizacao_15mais_estimado_norm": 1 / 3,
    "pct_sem_banheiro_sanitario_estimado_norm": 1 / 12,
    "pct_esgotamento_precario_estimado_norm": 1 / 12,
    "pct_sem_rede_geral_agua_estimado_norm": 1 / 12,
    "pct_lixo_destino_inadequado_estimado_norm": 1 / 12,
}


def normalize(df: DataFrame, up: Sequence[str] = (), down: Sequence[str] = (), suffix: str = "_norm") -> DataFrame:
    """Min-max over the whole frame: ``up`` columns rise to 1, ``down`` columns fall to 0.

    A constant column gives 0. All extremes come from one aggregate, read as a
    scalar subquery (one row whatever the input).
    """
    tagged = df.withColumn("__b", bounds(df, [*up, *down]))

    def scaled(c: str, inverted: bool) -> Column:
        x, lo, hi = F.col(c).cast("double"), F.col(f"__b.{c}_lo"), F.col(f"__b.{c}_hi")
        part = (hi - x) if inverted else (x - lo)
        return F.when(hi == lo, F.lit(0.0)).otherwise(part / F.nullif(hi - lo, F.lit(0.0)))

    out = {c + suffix: scaled(c, False) for c in up}
    out.update({c + suffix: scaled(c, True) for c in down})
    return tagged.withColumns(out).drop("__b")


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return normalize(df, up=cols)


def maxmin(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return normalize(df, down=cols)


def composite_index(cols: Sequence[str], weights: Mapping[str, float] | None = None) -> Column:
    """100 times the plain mean (nulls skipped), or a weighted sum (null propagates)."""
    if weights is None:
        return row_mean(*[F.col(c) for c in cols]) * 100
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(float(w))
    return total * 100


def weight_grid(k: int, step: float = 0.1, minimum: float = 0.0) -> list[list[float]]:
    """Every vector of ``k`` multiples of ``step``, each at least ``minimum``, summing to 1.

    Stars and bars: bar positions enumerate the compositions directly, first part
    ascending, so nothing outside the simplex is generated.
    """
    units, least = round(1 / step), round(minimum / step)
    free = units - k * least
    if free < 0:
        return []
    grid = []
    for bars in combinations(range(free + k - 1), k - 1):
        edges = (-1, *bars, free + k - 1)
        grid.append([(right - left - 1 + least) * step for left, right in zip(edges, edges[1:])])
    return grid


def weight_scores(units: DataFrame, unit: str, cols: Sequence[str], grid: Sequence[Sequence[float]]) -> DataFrame:
    """(unit, weight_id, score): each unit row exploded over the literal weight grid.

    Scores are rounded so that ties do not depend on the order of additions.
    """
    literal = F.array(*[F.array(*[F.lit(float(w)) for w in vector]) for vector in grid])
    long = units.dropna(subset=list(cols)).select(unit, *cols, F.posexplode(literal).alias("weight_id", "w"))
    score = F.lit(0.0)
    for i, c in enumerate(cols):
        score = score + F.col(c) * F.col("w")[i]
    return long.select(unit, "weight_id", F.round(score * 100, SCORE_DIGITS).alias("score"))


def weight_sensitivity(units: DataFrame, unit: str, cols: Sequence[str], grid: Sequence[Sequence[float]], top: int = 10) -> DataFrame:
    """How the rank of each unit moves over all weight vectors."""
    ranked = rank_min(weight_scores(units, unit, cols, grid), "score", "rank", by=["weight_id"])
    n_units = units.dropna(subset=list(cols)).agg(F.count(F.lit(1))).scalar()
    rank = F.col("rank").cast("double")
    ranked = ranked.withColumn("is_top", (F.col("rank") <= top).cast("double")).withColumn(
        "is_bottom", (F.col("rank") >= n_units - (top - 1)).cast("double")
    )
    # One group holds one rank per weight vector, a number fixed by the grid.
    return ranked.groupBy(unit).agg(
        F.avg(rank).alias("rank_medio"),
        F.percentile(rank, 0.5).alias("rank_mediano"),
        F.min("rank").alias("melhor_rank"),
        F.max("rank").alias("pior_rank"),
        (F.max("rank") - F.min("rank")).alias("amplitude_rank"),
        F.stddev_samp(rank).alias("desvio_rank"),
        F.percentile(rank, 0.05).alias("rank_p05"),
        F.percentile(rank, 0.95).alias("rank_p95"),
        F.avg("is_top").alias("freq_top10"),
        F.avg("is_bottom").alias("freq_bottom10"),
    )


def ranking(df: DataFrame, unit: str, value: str, out: str = "ranking") -> DataFrame:
    """Mean of ``value`` per unit, numbered from the highest; ties by unit."""
    return number_rows(mean_by(df, [unit], [value]), [F.col(value).desc(), unit], out)


def quantile_class(
    df: DataFrame,
    col: str,
    inclusive: bool = True,
    labels: tuple[str, str, str] = ("IQV baixo", "IQV médio", "IQV alto"),
    default: str | None = "Sem dados",
    out: str = "classe",
    probs: tuple[float, float] = (0.25, 0.75),
) -> DataFrame:
    """Three classes by exact quartiles of the frame.

    Inclusive: ``<= p25`` low, ``>= p75`` high, between is middle, null takes ``default``.
    Strict (``inclusive=False``): ``< p25`` low, ``> p75`` high, everything else takes
    the middle label, null included.
    """
    limits = exact_quantiles(df, col, {"p_lo": probs[0], "p_hi": probs[1]})
    tagged = df.withColumn("__q", limits.select(F.struct("p_lo", "p_hi")).scalar())
    x, lo, hi = F.col(col), F.col("__q.p_lo"), F.col("__q.p_hi")
    if inclusive:
        label = F.when(x <= lo, labels[0]).when((x > lo) & (x < hi), labels[1]).when(x >= hi, labels[2]).otherwise(default)
    else:
        label = F.when(x < lo, labels[0]).when(x > hi, labels[2]).otherwise(labels[1])
    return tagged.withColumn(out, label).drop("__q")


# Indicators of the index and their direction.
POSITIVE = ("rendimento_medio_responsavel_sm_estimado", "pct_alfabetizacao_15mais_estimado")
NEGATIVE = (
    "pct_sem_banheiro_sanitario_estimado", "pct_esgotamento_precario_estimado",
    "pct_sem_rede_geral_agua_estimado", "pct_lixo_destino_inadequado_estimado",
)


def index_features(df: DataFrame, pooled: Sequence[str], last_full_year: int = 2025) -> DataFrame:
    """Incident table with indicators to the feature table: pooled class, logs, norms, IQV and IQV_final."""
    # The running year is left out; a null year stays.
    df = df.where(~F.col("ano").eqNullSafe(last_full_year + 1))
    df = df.withColumn("OUTROS", any_positive(*[F.col(c) for c in pooled])).drop(*pooled)
    df = df.withColumns({
        "log_rendimento": F.log1p("rendimento_medio_responsavel_sm_estimado"), "log_pop": F.log1p(F.col("populacao_estimado").cast("double")),
    })
    df = normalize(df, POSITIVE, NEGATIVE)
    norms = [c + "_norm" for c in (*POSITIVE, *NEGATIVE)]
    return df.withColumns({"IQV": composite_index(norms), "IQV_final": composite_index(norms, FINAL_WEIGHTS)})
