"""Benchmark passages inside documents, found by suffix arrays of the documents.

Each chunk of documents (a shard) gets a word suffix array, sorted by the next ``window`` words.
It is sparse: a position whose next words include one that no benchmark item has, or that
crosses the end of its text, can't begin a match and gets no entry. Every benchmark suffix is then
searched in the array by bisection; the entries between its two bounds are all its places.

The benchmark travels to the executors in blocks of at most ``block_bytes``; a benchmark of several
blocks takes one pass per block, with a checkpoint between. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import checkpointed
from .batches import Words, chunks, lowered, text_bytes

WINDOW = 10
BLOCK_BYTES = 32 << 20

#: Word bytes: 0-9, a-z and all bytes of non-ASCII characters, after lower-casing.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True


class Block:
    """Benchmark windows, distinct and grouped by length, with the items that have them."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        data, at = text_bytes(pa.array(texts, pa.string()))
        data = lowered(data)
        words = Words(data, at, INSIDE[data])
        self.ids, self.vocabulary, codes = ids, words.distinct, words.codes + 1
        sizes = words.per_text
        spans = np.where(sizes >= window, window, sizes)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for span in np.unique(spans[spans > 0]).tolist():
            items = np.flatnonzero(spans == span)
            starts = np.concatenate([np.arange(words.first[i], words.first[i + 1] - span + 1) for i in items])
            owner = np.repeat(items, sizes[items] - span + 1)
            keys = packed(codes, starts, span)
            distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([number, owner]), axis=1)
            bounds = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
            self.groups.append((span, distinct, bounds, pairs[1], starts[first]))


def packed(codes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """The codes of the ``span`` words from each start as one byte string that sorts like the sequence."""
    columns = np.empty((len(starts), span), ">u4")
    for k in range(span):
        columns[:, k] = codes[starts + k]
    return columns.view(f"S{4 * span}").ravel()


def matches(block: Block, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: (length, places, window numbers, bounds, items of the windows, first benchmark place)."""
    for span, windows, bounds, items, first in block.groups:
        live = np.flatnonzero(room >= span)
        if not len(live):
            continue
        keys = packed(codes, live, span)
        order = np.argsort(keys, kind="stable")  # the suffix array
        array = keys[order]
        low, high = np.searchsorted(array, windows, "left"), np.searchsorted(array, windows, "right")
        count = high - low
        if count.sum():
            number = np.repeat(np.arange(len(windows)), count)
            ends = np.cumsum(count)
            entry = np.repeat(low - (ends - count), count) + np.arange(int(ends[-1]))
            yield span, live[order[entry]], number, bounds, items, first


def room_after(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words from each position to the next unknown word or the end of the text."""
    n = len(codes)
    stop = np.zeros(n + 1, bool)
    stop[:n] = codes == 0
    stop[first] = True
    where = np.flatnonzero(stop)
    position = np.arange(n)
    beyond = where[np.searchsorted(where, position, side="right")] if n else where[:0]
    return np.where(codes > 0, beyond - position, 0)


def scan(block: Block, data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray, list[set[str]], np.ndarray, np.ndarray]:
    """(words, hit flags, items by text, longest match in words by text, its first word)."""
    low = lowered(data)
    words = Words(low, at, INSIDE[low])
    known = pc.index_in(words.distinct, value_set=block.vocabulary)
    to_code = np.asarray(known.fill_null(-1)).astype(np.int64) + 1
    codes = to_code[words.codes] if len(to_code) else words.codes
    texts = len(at) - 1
    text_of = words.text_of()
    cover = np.zeros(len(codes) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(texts)]
    longest, where = np.zeros(texts, np.int64), np.full(texts, -1, np.int64)
    for span, places, number, bounds, items, first in matches(block, codes, room_after(codes, words.first)):
        np.add.at(cover, places, 1)
        np.add.at(cover, places + span, -1)
        pairs = np.unique(np.stack([text_of[places], number]), axis=1)
        for text, window in pairs.T.tolist():
            found[text].update(block.ids[i] for i in items[bounds[window] : bounds[window + 1]].tolist())
        diagonal = places - first[number]
        order = np.lexsort((places, diagonal, text_of[places]))
        p, d, t = places[order], diagonal[order], text_of[places[order]]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(p))) - 1 + span
        for k in np.argsort(length, kind="stable").tolist():
            text = int(t[begin[k]])
            if length[k] > longest[text]:
                longest[text], where[text] = length[k], p[begin[k]] - words.first[text]
    return words, np.cumsum(cover[:-1]) > 0, found, longest, where


#: What a pass adds to each row; ``_hits`` holds the hit words as packed bits, so passes can be joined.
PASS = [T.StructField("_words", T.LongType()), T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_n_hit", T.LongType()), T.StructField("_longest", T.LongType()), T.StructField("_longest_at", T.LongType())]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        if ids and size + len(row[1] or "") > block_bytes:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row[0] or "")
        texts.append(row[1])
        size += len(row[1] or "")
    yield Block(ids, texts, window)


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus the columns of PASS. A null text has no words; an item without words
    (null, empty, signs only) has no window; an item shorter than ``window`` is one window; repeated
    rows give repeated results; a null item_id counts as the empty string."""
    out = docs.drop(*[f.name for f in PASS])
    names = out.columns
    for turn, block in enumerate(_blocks(benchmark, item, "text", window, block_bytes)):
        shared = out.sparkSession.sparkContext.broadcast(block)
        later = turn > 0
        if later:
            out = checkpointed(out)
        schema = T.StructType([*(f for f in out.schema.fields if f.name in names), *PASS])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=later) -> Iterator[pa.RecordBatch]:
            for rows, data, at in chunks(batches, text):
                words, hit, found, longest, where = scan(shared.value, data, at)
                bits = []
                for k in range(rows.num_rows):
                    own = hit[words.first[k] : words.first[k + 1]]
                    bits.append(np.packbits(own) if own.any() else np.empty(0, np.uint8))
                if later:
                    old = [rows.column(rows.schema.get_field_index(f.name)).to_pylist() for f in PASS]
                    for k in range(rows.num_rows):
                        before = np.frombuffer(old[1][k], np.uint8)
                        bits[k] = before | bits[k] if len(before) and len(bits[k]) else before if len(before) else bits[k]
                        found[k].update(old[2][k])
                        if old[4][k] >= longest[k]:
                            longest[k], where[k] = old[4][k], old[5][k]
                made = [
                    pa.array(words.per_text, pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary()),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array([int(np.bitwise_count(b).sum()) for b in bits], pa.int64()), pa.array(longest), pa.array(where),
                ]
                kept = [rows.column(k) for k, n in enumerate(rows.schema.names) if n in names]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*(n for n in rows.schema.names if n in names), *(f.name for f in PASS)])

        out = out.mapInArrow(run, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_match_at (word number, -1: none).
    longest_match follows a run of windows along the benchmark's first place of each window."""
    out = marked(docs.select(key, "text"), benchmark, **options)
    return out.select(
        F.col(key), F.col("_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.length("_hits") > 0).alias("contaminated"),
        F.col("_longest").alias("longest_match"), F.col("_longest_at").alias("longest_match_at"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns unchanged."""
    return marked(docs, benchmark, **options).where(F.length("_hits") == 0).select(*[F.col(c) for c in docs.columns])

