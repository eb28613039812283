"""Registry of queries over a directory of parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[["Tables"], DataFrame]


class Tables:
    """Parquet tables of one directory, read on attribute access (columns are pruned by the plan)."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _REGISTRY[name or fn.__name__] = (fn, sql)
        return fn

    return register


@lru_cache(maxsize=1)
def registry() -> dict[str, tuple[Query, str | None]]:
    from . import domain_queries, incident_queries, index_queries, io_queries, linear_queries, model_queries, panel_queries, quality_queries, table_queries  # noqa: F401

    return dict(_REGISTRY)


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def round_all(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in cols})


def iso(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd")
