"""Portal listings: HTML rows and links, latest file, change detection, ingest state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import DAY_MONTH_YEAR_MINUTE, parse_date
from .commits import current, publish

ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<td\b[^>]*>(.*?)</td>"
HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"
TAG = r"(?s)<[^>]*>"
# Entities unescaped in cell text and links.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def links(c: Column) -> Column:
    """Link targets of an HTML fragment, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(HREF), F.lit(1)), unescape)


def html_table_rows(df: DataFrame, html: str) -> DataFrame:
    """One row per table row: position and cells ``{text, links}``; rows without cells are left out."""
    rows = df.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(1))).alias("row", "__row"))
    cells = F.transform(
        F.regexp_extract_all("__row", F.lit(CELL), F.lit(1)),
        lambda c: F.struct(F.trim(unescape(F.regexp_replace(c, TAG, ""))).alias("text"), links(c).alias("links")),
    )
    return rows.withColumn("cells", cells).drop("__row").where(F.size("cells") > 0)


def html_links(df: DataFrame, html: str) -> DataFrame:
    """One row per link of a page: position and target."""
    return df.select("*", F.posexplode(links(F.col(html))).alias("position", "href"))


def url_file_name(url: Column) -> Column:
    return F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1)


def file_candidates(rows: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of at least four cells whose first link ends in ``suffix``."""
    url = F.try_element_at(F.col("cells")[0]["links"], F.lit(1))
    wide = rows.where(F.size("cells") >= 4).withColumn("url", url)
    return wide.where(F.col("url").endswith(suffix)).select(
        *keep, "url", url_file_name(F.col("url")).alias("filename"),
        F.col("cells")[2]["text"].alias("portal_updated_at"), F.col("cells")[3]["text"].alias("portal_size"),
    )


def listing_html(responses: DataFrame, body: str = "body") -> DataFrame:
    """Decode portal JSON answers; a failed answer raises with the portal's message."""
    parsed = responses.withColumn("__r", F.from_json(F.col(body), "sucesso boolean, erro string, tabela string"))
    message = F.coalesce(F.col("__r.erro"), F.lit("the portal did not list any file"))
    ok = F.assert_true(F.coalesce(F.col("__r.sucesso"), F.lit(False)), message).isNull()
    return parsed.where(ok).select(*[c for c in responses.columns if c != body], F.col("__r.tabela").alias("html"))


def latest_by(df: DataFrame, order: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the highest ``order`` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*")


def latest_file(candidates: DataFrame) -> DataFrame:
    return latest_by(candidates, parse_date(F.col("portal_updated_at"), DAY_MONTH_YEAR_MINUTE))


STATE_FIELDS: Mapping[str, str] = {
    "latest_file": "filename", "latest_url": "url", "portal_updated_at": "portal_updated_at", "portal_size": "portal_size",
}


def changed(current: DataFrame, state: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows of ``current`` that are new or differ from ``state`` in any column (null-safe)."""
    old = state.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in cols], F.lit(True).alias("__seen"))
    joined = current.join(old, list(keys), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in cols])
    return joined.where(F.col("__seen").isNull() | differs).select(*current.columns)


def ingest_state(latest: DataFrame) -> DataFrame:
    """State row to save after a download."""
    return latest.select(*[F.col(src).alias(name) for name, src in STATE_FIELDS.items()], F.current_timestamp().alias("downloaded_at"))


def save_state(latest: DataFrame, path: str) -> None:
    """Make the one-row state the next version of the log under ``path``."""
    publish(ingest_state(latest), path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state saved last, whole; no row before the first download."""
    schema = "latest_file string, latest_url string, portal_updated_at string, portal_size string, downloaded_at timestamp"
    saved = current(spark, path)
    return spark.createDataFrame([], schema) if saved is None else saved


def has_new_file(latest: DataFrame, state: DataFrame) -> DataFrame:
    """The latest file when it differs from the saved state, else no row."""
    tagged = latest.withColumns({name: F.col(src) for name, src in STATE_FIELDS.items()}).withColumn("dataset", F.lit(1))
    return changed(tagged, state.withColumn("dataset", F.lit(1)), ["dataset"], list(STATE_FIELDS)).select(*latest.columns)
