"""Arrow batches as flat numpy arrays: texts, words and hashes without per-row Python.

Texts of a batch are one byte array plus offsets. A null text has no bytes. Work is cut
into chunks of about ``CHUNK_BYTES`` text bytes, so memory does not follow the batch size;
a single text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 8 << 20

#: The separators of ``[^\x20\x09-\x0D]+``.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for slices of the batches of about ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(begin, end - begin), data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
            begin = end


def mask_of(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def spans_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at the text bounds ``at``."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = at[(at > 0) & (at < len(inside))]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The byte strings ``data[starts[i]:ends[i]]`` for ascending, disjoint spans."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and offsets[-1] != len(data):
        step = np.zeros(len(data) + 1, np.int8)
        np.add.at(step, starts, 1)
        np.add.at(step, ends, -1)
        data = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    data = np.ascontiguousarray(data)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Words:
    """The words of a chunk: ``starts``/``ends`` in bytes, ``first`` word of each text (n + 1), ``codes`` into ``distinct``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray):
        self.starts, self.ends = spans_of(inside, at)
        self.first = np.searchsorted(self.starts, at)
        coded = slices(data, self.starts, self.ends).dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread bits from any uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(strings: pa.BinaryArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte string: polynomial over the bytes, then mixed; equal strings agree everywhere."""
    data, at = text_bytes(strings)
    lengths = np.diff(at)
    out = np.zeros(len(strings), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    for step in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > step) if step else np.flatnonzero(lengths)
        if len(live) * 8 < len(strings) and step > 64:  # few long strings are left: finish each one alone
            for k in live:
                h = int(out[k])
                for byte in data[at[k] + step : at[k + 1]].tolist():
                    h = ((h ^ (h >> 29)) * int(base) + byte + 1) & 0xFFFFFFFFFFFFFFFF
                out[k] = h
            break
        h = out[live]
        out[live] = (h ^ (h >> np.uint64(29))) * base + data[at[live] + step].astype(np.uint64) + np.uint64(1)
    return mixed(out ^ mixed(lengths.astype(np.uint64) + np.uint64(seed * 2 + 1)))


def total_per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-word) array between successive bounds."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[at[1:]] - running[at[:-1]]


def emit(rows: pa.RecordBatch, keep: dict[str, str], made: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """Input columns ``keep`` (name -> new name) beside new columns."""
    arrays = [rows.column(rows.schema.get_field_index(c)) for c in keep]
    arrays += [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in made.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep.values(), *made])
