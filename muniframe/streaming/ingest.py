"""Poll-and-diff ingestion as a file stream.

The stream's checkpoint plays the part of the saved download state: each file is
handed over once. ``availableNow`` takes what is there and stops, like one poll.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.bronze import load_bronze, write_bronze

#: Files of one micro-batch at most: the list of their paths is all that the driver sees.
BATCH_FILES = 1000
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """Stream of arriving CSV paths under ``root/<source>/``; the pruned content column is never read."""
    files = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", BATCH_FILES)
    return files.load(f"{root.rstrip('/')}/*").select("path")


def ingest_once(spark: SparkSession, root: str, out: str, checkpoint: str, comma_sources: Iterable[str] = ()) -> StreamingQuery:
    """Load every CSV file that arrived since the last run into bronze.

    Records are replaced per file, so a batch repeated after a failure writes the
    same rows again.
    """
    comma_sources = list(comma_sources)

    def load(batch: DataFrame, _: int) -> None:
        paths = [row["path"] for row in batch.collect()]
        if paths:
            registry, records = load_bronze(batch.sparkSession, root, comma_sources=comma_sources, paths=paths)
            write_bronze(batch.sparkSession, registry, records, out)

    return new_files(spark, root).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
