"""Packed texts for shuffles, and the package's place for Python workers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..session import stored
from .batches import chunks


__all__ = ["opened", "packed_texts", "reachable", "stored"]


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in. Where it is
    installed on the executors the extra path does no harm."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def packed_texts(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc, carried columns, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for rows, data, at in chunks(batches, "text"):
            packed = [squeeze(data[a:b]) for a, b in zip(at, at[1:])]
            kept = [rows.column(k) for k in range(rows.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], names=["doc", *carry, "packed"])

    others = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select("doc", *carry, "text").mapInArrow(run, f"doc long, {others}packed binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc, packed) as batches of (doc, text)."""
    open_up = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            texts = pa.array([open_up(p.as_buffer()) for p in part.column(1)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["doc", "text"])
