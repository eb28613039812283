"""A log of whole versions: numbered manifests, written once, never renamed or replaced.

A manifest is a folder of rows that names what is valid: the folders of data, or a saved state. It counts once its
success mark is there, and readers take the highest that counts. A writer that stops at any point leaves the version
before it in force, and the number it may have begun is never used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARK = "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> dict[int, bool]:
    """Number of every manifest under ``root``, and whether it is complete."""
    fs, place = _folder(spark, root)
    if not fs.exists(place):
        return {}
    numbers = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().isdigit()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return {int(n): fs.exists(path(path(place, n), MARK)) for n in numbers}


def publish(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next version and return its number. Two writers of one number: the second fails."""
    number = max(versions(rows.sparkSession, root), default=0) + 1
    rows.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{root}/{number:012d}")
    return number


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the highest complete version; None before the first one."""
    whole = [n for n, complete in versions(spark, root).items() if complete]
    return spark.read.parquet(f"{root}/{max(whole):012d}") if whole else None
