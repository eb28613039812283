"""Chat formatting of conversation turns, by columnar byte assembly, and reading it back.

Template of a turn: ``<|turn|>`` role ``<|says|>`` text ``<|end|>``; a conversation is its turns one after
another. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string, and undoing both steps gives the text back exactly.

A turn is formatted on its own, so a conversation of any length never meets in one place: segment lengths,
cumulative offsets and scatter indices of a batch are computed in numpy, and all bytes are copied into one
buffer. Only the digests of whole conversations need the turns in order; they stream through a sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import chunks, text_bytes

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LEARNED = "assistant"

FORMATTED = [T.StructField("formatted", T.StringType()), T.StructField("loss_begin", T.LongType()), T.StructField("loss_end", T.LongType())]


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(column.fill_null(""), "\\", "\\\\"), "<|", "<\\|")


def unescaped(text: str) -> str:
    """``<\\|`` (one backslash: the doubled ones are even in number) first, then the doubled backslashes."""
    return text.replace("<\\|", "<|").replace("\\\\", "\\")


def assembled(role: pa.Array, text: pa.Array) -> pa.Array:
    """One string per row: header, role, separator, text, footer, scattered into one preallocated buffer."""
    n = len(role)
    columns = [TURN, role, SAYS, text, END]
    parts = []
    for c in columns:
        data, at = (np.frombuffer(c.encode(), np.uint8), None) if isinstance(c, str) else text_bytes(c)
        parts.append((data, at, np.full(n, len(data)) if at is None else np.diff(at)))
    lengths = np.stack([p[2] for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(parts))
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, at, size) in enumerate(parts):
        if at is None:
            out[(begins[:, k, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
        elif len(data):
            out[np.repeat(begins[:, k] - at[:-1], size) + np.arange(len(data))] = data
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:] = ends[:, -1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """All columns plus ``formatted`` and its loss mask [loss_begin, loss_end) in code points of ``formatted``: the escaped
    text of an assistant turn, empty for other roles. Null role or text: empty. Equal input columns of those names are replaced."""
    turns = turns.drop(*[f.name for f in FORMATTED])
    schema = T.StructType([*turns.schema.fields, *FORMATTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, text):
            said = escaped(rows.column(rows.schema.get_field_index(text)))
            who = rows.column(rows.schema.get_field_index(role))
            named = escaped(who)
            begin = len(TURN) + len(SAYS) + np.asarray(pc.utf8_length(named)).astype(np.int64)
            learned = np.asarray(pc.equal(who.fill_null(""), LEARNED))
            size = np.asarray(pc.utf8_length(said)).astype(np.int64)
            made = [assembled(named, said), pa.array(begin), pa.array(begin + np.where(learned, size, 0))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, *(f.name for f in FORMATTED)])

    return turns.mapInArrow(run, schema)


def parsed(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, _, rest = formatted[len(TURN) :].partition(SAYS)
    return unescaped(role), unescaped(rest[: len(rest) - len(END)])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation, read from ``formatted`` and the loss mask alone. Turns are put in order by (turn, role, text),
    nulls first, which settles ties. A task streams its conversations and holds one turn; SHA-256 is sequential, so
    a conversation's digest is one task's work whatever its length."""
    ordered = formatted.select(F.col(key).cast("long").alias("conv_id"), "turn", "role", "text", *[f.name for f in FORMATTED])
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", *[f.name for f in FORMATTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGESTS.split(", ")])

        for batch in batches:
            for conv, said, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(said)
                learned = unescaped(said[begin:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(said)
            if len(done) >= 10_000:
                yield flush()
        if state is not None:
            close()
        if done:
            yield flush()

    return ordered.mapInArrow(run, DIGESTS)
