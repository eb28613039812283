"""Features of GeoJSON documents of any size, also of those written in one line.

A document is cut at closing braces into chunks. Two things have to be known where a chunk begins: whether a string is open, and how
deep the nesting is. A chunk turns the first over by the parity of its quotes, and adds to the second the brackets outside of
strings, counted for either case; both compose along a file as running sums. A feature is an object that opens at depth two. A chunk gives out
the features it holds whole, and pieces of those that cross its borders, which are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stored
from .records import BROADCAST_CHUNKS, in_chunks

CHUNK = 4 << 20
PLACE = ["path", "block", "chunk"]

ESCAPE = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.S)
REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"?', re.S)
DEPTH = 2


def brackets(text: str) -> tuple[int, int, int]:
    """(quotes modulo 2, depth gained when entered outside strings, when entered inside one)."""
    parts = ESCAPE.sub("", text).split('"')
    gained = [sum(p.count(c) for c in "{[") - sum(p.count(c) for c in "}]") for p in parts]
    return (len(parts) - 1) % 2, sum(gained[::2]), sum(gained[1::2])


def cut_features(text: str, quoted: bool, depth: int) -> tuple[list[str], str | None, str | None]:
    """(features that begin and end here, the end of one from before, the beginning of one that goes on) of a text entered in a state.
    A text inside a single feature is an end that does not end."""
    at = REST_OF_STRING.match(text).end() if quoted else 0
    whole, lead, begun = [], None, 0 if depth > DEPTH else None
    from_before = depth > DEPTH
    for token in TOKEN.finditer(text, at):
        mark = token[0]
        if mark in "{[":
            if depth == DEPTH and mark == "{":
                begun = token.start()
            depth += 1
        elif mark in "}]":
            depth -= 1
            if depth == DEPTH and begun is not None:
                if from_before:
                    lead, from_before = text[: token.end()], False
                else:
                    whole.append(text[begun : token.end()])
                begun = None
    if begun is None:
        return whole, lead, None
    return (whole, text, None) if from_before else (whole, lead, text[begun:])


FOUND = "path string, block long, chunk int, kind string, text string"


def feature_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(text): the JSON text of every object at depth two of the documents, stored."""
    pieces = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths))
    raw = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, _, block), chunk, data in in_chunks(batches, b"}", CHUNK):
            text = data.decode("utf-8", "replace")
            made = (path, block, chunk, text, *brackets(text))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names=[*PLACE, "text", "turns", "outside", "inside"])

    chunks = stored(raw.mapInArrow(scan, "path string, block long, chunk int, text string, turns int, outside long, inside long"))
    earlier = Window.partitionBy("path").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    states = chunks.drop("text").withColumn("quoted", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2 == 1)
    gained = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    states = stored(states.withColumn("depth", F.coalesce(F.sum(gained).over(earlier), F.lit(0))).select(*PLACE, "quoted", "depth"))
    few = states.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS
    placed = chunks.select(*PLACE, "text").join(F.broadcast(states) if few else states, PLACE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, chunk, text, quoted, depth in zip(*(c.to_pylist() for c in batch.columns)):
                whole, lead, begun = cut_features(text, quoted, depth)
                kinds = ["whole"] * len(whole) + ["lead"] * (lead is not None) + ["open"] * (begun is not None)
                texts = [*whole, *(x for x in (lead, begun) if x is not None)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([chunk] * n, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=[*PLACE, "kind", "text"])

    found = stored(placed.select(*PLACE, "text", "quoted", "depth").mapInArrow(cut, FOUND))
    # Within a chunk the end of an earlier feature comes before the beginning of the next.
    order = Window.partitionBy("path").orderBy("block", "chunk", "kind").rowsBetween(Window.unboundedPreceding, 0)
    crossing = found.where("kind <> 'whole'").withColumn("owner", F.last(F.when(F.col("kind") == "open", F.struct("block", "chunk")), True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "chunk", "text")))
    joined = crossing.groupBy("path", "owner").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return found.where("kind = 'whole'").select("text").unionByName(joined.select("text"))


def read_geojson(spark: SparkSession, path: str | Sequence[str], properties: Sequence[str]) -> DataFrame:
    """One row per feature: the named properties as text (null where it has none) and the geometry as JSON text.

    Documents are feature collections; one file may hold several, one document may be any size and is read by many tasks."""
    fields = ", ".join(f"`{p}`: string" for p in properties)
    feature = F.from_json("text", f"type string, properties struct<{fields}>, geometry string").alias("f")
    rows = feature_texts(spark, path).select(feature).where(F.col("f.type") == "Feature")
    return rows.select(*[F.col(f"f.properties.`{p}`").alias(p) for p in properties], F.col("f.geometry").alias("geometry"))
