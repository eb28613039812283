"""Bronze layer: every CSV record of every source as one JSON payload.

Files are read in splits by ``records``: one scan, records numbered along the file, quoted line breaks kept. The registry counts what the
automaton sees, the payloads come from the parser, so comparing the two before the write is a check.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .commits import current, publish
from .files import LATIN1
from .records import chunks_of, file_counts, payloads, places_of

FILE_KEY = ["source", "file_name"]
DELIMITERS = (";", ",")


def _named(path: str) -> list[Column]:
    parts = F.split(path, "/")
    return [F.element_at(parts, -2).alias("source"), F.element_at(parts, -1).alias("file_name")]


def file_id() -> Column:
    return F.sha2(F.concat_ws("\u0001", *FILE_KEY), 256)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace existing ones with the same key."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def load_bronze(
    spark: SparkSession, root: str, source: str | None = None, comma_sources: Iterable[str] = (), paths: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(registry, records) for all CSV files under ``root/<source>/``, or for the named ``paths``.

    Records: source, file_name, raw_file_id, row_number (from 1), payload, loaded_at. A file's delimiter is the one its first 8 KiB
    show; where they show none, ``,`` for ``comma_sources``, else ``;``. Registry rows carry n_records. A file without any byte is
    not listed."""
    chunks = chunks_of(spark, paths or f"{root.rstrip('/')}/{source or '*'}/*.csv", LATIN1, DELIMITERS)
    own = F.element_at(F.split("path", "/"), -2)
    places = places_of(chunks, DELIMITERS, F.when(own.isin(*comma_sources), ",").otherwise(";"))
    now = F.current_timestamp().alias("loaded_at")
    files = file_counts(places).select(*_named("path"), F.col("path").alias("file_path"), F.col("size").alias("file_size_bytes"), "n")
    registry = files.select(file_id().alias("id"), *FILE_KEY, "file_path", "file_size_bytes", now, F.col("n").alias("n_records"))
    rows = payloads(chunks, places).select(*_named("path"), F.col("record").alias("row_number"), F.col("made").alias("payload"))
    return registry, rows.select(*FILE_KEY, file_id().alias("raw_file_id"), "row_number", "payload", now)


def check_complete(registry: DataFrame, records: DataFrame) -> None:
    """Fail unless every file has as many records as its registry row says."""
    counted = records.groupBy(F.col("raw_file_id").alias("id")).agg(F.count(F.lit(1)).alias("found"))
    both = registry.select("id", "file_name", "n_records").join(counted, "id", "left").where(F.coalesce("found", F.lit(0)) != F.col("n_records"))
    wrong = both.limit(5).collect()
    if wrong:
        raise ValueError(f"records and registry differ: {wrong}")


REGISTRY, RECORDS = "raw_files", "raw_records"
RECORD = "row_number long, payload string, loaded_at timestamp, load string, source string, raw_file_id string"


def read_registry(spark: SparkSession, out: str) -> DataFrame | None:
    """The registry in force under ``out``: one row per file, with the load that holds its records. None before the first load."""
    return current(spark, f"{out}/{REGISTRY}")


def _loads(spark: SparkSession, out: str, loads: list[str]) -> DataFrame:
    places = [f"{out}/{RECORDS}/load={load}" for load in loads]
    return spark.read.schema(f"file_name string, {RECORD}").option("basePath", f"{out}/{RECORDS}").parquet(*places)


def read_records(spark: SparkSession, out: str) -> DataFrame | None:
    """All records in force under ``out``. A load's folder may hold files that a later load has replaced; the registry tells which count."""
    registry = read_registry(spark, out)
    if registry is None:
        return None
    loads = sorted(r["load"] for r in registry.select("load").distinct().collect())  # one row per load still in use
    valid = registry.select(F.col("id").alias("raw_file_id"), "load")
    return _loads(spark, out, loads).join(valid, ["raw_file_id", "load"], "left_semi").drop("load")


def write_bronze(spark: SparkSession, registry: DataFrame, records: DataFrame, out: str) -> None:
    """Upsert the registry and replace the records of every loaded file, after checking that none is missing.

    The records go to a folder of their own, partitioned by (source, raw_file_id), row ranges of a large file to different tasks. Once they are all
    there, the next version of the registry names that folder for the loaded files. Nothing is overwritten, renamed or deleted, so
    readers see the version before or this one, wherever a load stops.
    """
    load = uuid.uuid4().hex
    spread = records.repartition("raw_file_id", F.floor(F.col("row_number") / 1_000_000))
    spread.write.partitionBy("source", "raw_file_id").parquet(f"{out}/{RECORDS}/load={load}")
    check_complete(registry, _loads(spark, out, [load]))
    loaded, old = registry.withColumn("load", F.lit(load)), read_registry(spark, out)
    publish(upsert(old, loaded, FILE_KEY) if old is not None else loaded, f"{out}/{REGISTRY}")


def row_payload(df: DataFrame, exclude: Iterable[str] = ()) -> Column:
    """All columns of a row as JSON text, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in set(exclude)]), {"ignoreNullFields": "false"})
