"""Delimited text, listings and result sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records import cells, chunks_of, header_cells, places_of

LATIN1, UTF8 = "ISO-8859-1", "UTF-8"


def string_schema(columns: Iterable[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


# Cells that common CSV readers take for a missing value.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = LATIN1, columns: Sequence[str] | None = None,
    null_words: Sequence[str] = NULL_WORDS, quoted_breaks: bool = True,
) -> DataFrame:
    """All-string CSV with a header; ``columns`` picks some of them by name, else the first file's header names them.

    Cells equal to one of ``null_words`` are null. Quoted cells may hold line breaks: files are cut into splits of any place and
    records put together across them (one scan, kept in the checkpoint folder). ``quoted_breaks=False`` reads files that have none
    without that scan, lazily.
    """
    if quoted_breaks:
        chunks = chunks_of(spark, path, encoding, [sep])
        places = places_of(chunks, [sep])
        if columns is None:
            first = places.where("opens").orderBy("path").select("header").first()
            columns = header_cells(first["header"], sep) if first else ()
        read = cells(chunks, places, columns)
    else:
        reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).option("escape", '"')
        if columns is not None:
            reader = reader.schema(string_schema(columns)).option("enforceSchema", False)
        read = reader.csv(path)
    if not null_words:
        return read
    return read.select(*[F.when(~F.col(f"`{c}`").isin(*null_words), F.col(f"`{c}`")).alias(c) for c in read.columns])


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File listing (path, name, length, modificationTime); contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def required_files(files: DataFrame, names: Iterable[str]) -> DataFrame:
    """Listed files that are on an allow-list."""
    return files.where(F.col("name").isin(*sorted(names)))


def superseded_files(files: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Listed files that are not on the keep-list."""
    return files.where(~F.col("name").isin(*sorted(keep)))


def write_delimited(df: DataFrame, path: str, sep: str = ";", encoding: str = LATIN1, mode: str = "overwrite") -> None:
    """Interchange CSV (one part file per task). Quotes in cells are doubled, blanks kept; null and empty cells look alike."""
    plain = {"sep": sep, "encoding": encoding, "header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(**plain).csv(path)


def write_distinct_values(values: DataFrame, path: str, column: str = "value") -> None:
    """Sorted distinct values, one per line, range-partitioned over part files."""
    values.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append") -> None:
    """Relational sink; needs the driver jar on the class path."""
    df.write.jdbc(url, table, mode, properties)
