"""Byte-level BPE encoding and decoding of a text column.

Boundaries of pre-tokens come from codepoint-class arrays and an associative scan over the
transition functions of a small automaton, not from a regular expression. The slices between
them are dictionary-encoded, and pair merging runs once per distinct slice of a chunk, for all
slices side by side. Token byte offsets turn decoding into one gather.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import chunks, slices, text_bytes

# Symbols: what the automaton reads for one codepoint.
LETTER, NUMBER, OTHER, GLUE, LONE, BLANK, SHORT, LONG = range(8)
# States: what kind of pre-token the last codepoint belongs to.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUED, CLOSED, IN_BLANKS, ONE_MORE, TWO_MORE = range(9)
SYMBOLS, STATES = 8, 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a pre-token begin here) by symbol and state.

    GLUE is a space before a non-blank (it joins what follows), LONE another blank before a
    non-blank, BLANK any other blank, SHORT and LONG an apostrophe before s/t/m/d and before
    re/ve/ll: a contraction unless it continues a run of other signs or follows a space.
    """
    to = np.zeros((SYMBOLS, STATES), np.uint8)
    begins = np.ones((SYMBOLS, STATES), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        to[symbol] = state
        begins[symbol, [state, GLUED]] = False
    to[GLUE], to[LONE], to[BLANK] = GLUED, CLOSED, IN_BLANKS
    begins[BLANK, IN_BLANKS] = False
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        to[symbol] = state
        for within in (IN_OTHERS, GLUED):
            to[symbol, within], begins[symbol, within] = IN_OTHERS, False
    to[:, TWO_MORE], begins[:, TWO_MORE] = ONE_MORE, False
    to[:, ONE_MORE], begins[:, ONE_MORE] = CLOSED, False
    return to, begins


NEXT, BEGINS = _automaton()
#: Blanks in the sense of the pattern: Unicode White_Space (fixed values).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for each codepoint, from its general category."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[SPACES] = BLANK
    return table


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codepoints of UTF-8 bytes and the byte position of each."""
    lead = (data & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    if len(where) == len(data):
        return data.astype(np.uint32), where
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), where


def _symbols(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the automaton reads; ``first`` holds the texts' first codepoints (and the end)."""
    kind = classes()[code]
    n = len(code)
    final = np.zeros(n + 2, bool)
    final[np.maximum(first[1:] - 1, 0)] = True  # last codepoint of a text
    after = np.append(kind[1:], BLANK)
    ends = final[:n]
    symbol = kind.copy()
    before_text = (kind == BLANK) & (after != BLANK) & ~ends
    symbol[before_text] = LONE
    symbol[before_text & (code == 0x20)] = GLUE
    for k in np.flatnonzero((code == 0x27) & ~ends):
        one = code[k + 1]
        if one in (0x73, 0x74, 0x6D, 0x64):
            symbol[k] = SHORT
        elif k + 2 < n and not final[k + 1] and (one, code[k + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            symbol[k] = LONG
    return symbol


def boundaries(symbol: np.ndarray, opens: np.ndarray, block: int = 256) -> np.ndarray:
    """Where pre-tokens begin, by a blocked scan: compose each block's transition functions,
    scan the compositions, then run all blocks from their known entry states at once.
    ``opens`` marks first codepoints of texts: there the function is constant."""
    n = len(symbol)
    if not n:
        return np.empty(0, bool)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint8)
    padded[:n] = symbol + np.where(opens, SYMBOLS, 0).astype(np.uint8)
    step = np.vstack([NEXT, np.repeat(NEXT[:, START : START + 1], STATES, axis=1)])  # reading from START, whatever came before
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    flat = step.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = flat[(column.astype(np.int32) * STATES)[:, None] + whole]
    hop = 1  # inclusive scan of the blocks' functions; composition is associative
    while hop < rows:
        later = np.take_along_axis(whole[hop:], whole[:-hop], axis=1)
        whole = np.concatenate([whole[:hop], later])
        hop *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = whole[:-1, START]
    begin = np.empty((block, rows), bool)
    marks = np.vstack([BEGINS, np.ones_like(BEGINS)]).ravel()
    for k, column in enumerate(grid):
        at = column.astype(np.int32) * STATES + state
        begin[k] = marks[at]
        state = flat[at]
    return begin.T.ravel()[:n]


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens, and the number of the first one of each text (n + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    code, where = codepoints(data)
    first = np.searchsorted(where, at)
    opens = np.zeros(len(code) + 1, bool)
    opens[first] = True
    starts = where[boundaries(_symbols(code, first), opens[:-1])]
    return starts, np.searchsorted(starts, at)


class Ranks:
    """A rank file, its token bytes and the mergeable pairs as sorted arrays."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, number = line.split()
                    self.rank[base64.b64decode(token)] = int(number)
        size = max(self.rank.values(), default=-1) + 1
        self.token = [b""] * size
        for token, number in self.rank.items():
            self.token[number] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (left << 32 | right, number)
            for token, number in self.rank.items()
            for cut in range(1, len(token))
            if (left := self.rank.get(token[:cut])) is not None and (right := self.rank.get(token[cut:])) is not None
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.slots = 1
        while self.slots < 4 * max(1, len(table)):
            self.slots *= 2
        self.keys, self.numbers = np.full(self.slots, -1, np.int64), np.full(self.slots, NEVER, np.int64)
        open_, k = np.arange(len(table)), self._slot(table[:, 0])
        while len(open_):  # each round fills the free slots, one key a slot; the rest move on
            _, first = np.unique(k, return_index=True)
            first = first[self.keys[k[first]] < 0]
            self.keys[k[first]], self.numbers[k[first]] = table[open_[first], 0], table[open_[first], 1]
            left = np.ones(len(open_), bool)
            left[first] = False
            open_, k = open_[left], (k[left] + 1) % self.slots
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in self.token])])
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.slots

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, NEVER where it is no token."""
        key = left << 32 | right
        k = self._slot(key)
        out = np.full(len(key), NEVER, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[k]
            hit = found == key[open_]
            out[open_[hit]] = self.numbers[k[hit]]
            go = ~hit & (found >= 0)
            open_, k = open_[go], (k[go] + 1) % self.slots
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, gathered by their offsets."""
        lengths = self.token_at[ids + 1] - self.token_at[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.token_at[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.token_bytes[source]


NEVER = 1 << 40
#: Slices above this length are merged one by one with a heap; padding them would be wasteful.
LONG_SLICE = 48
#: Text bytes encoded at once; the arrays beside them take some 80 times as much.
CHUNK = 2 << 20


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _merge_alone(piece: bytes, r: Ranks) -> list[int]:
    """Lowest rank first, leftmost first, with a heap: for long slices."""
    import heapq

    ids = r.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    text = [bytes([b]) for b in piece]
    rank = r.rank
    heap = [(k, i, text[i], text[i + 1]) for i in range(n - 1) if (k := rank.get(text[i] + text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if not live[i] or j >= n or text[i] != a or text[j] != b:
            continue
        text[i] += text[j]
        live[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (k := rank.get(text[i] + text[after[i]])) is not None:
                heapq.heappush(heap, (k, i, text[i], text[after[i]]))
        if before[i] >= 0 and (k := rank.get(text[before[i]] + text[i])) is not None:
            heapq.heappush(heap, (k, before[i], text[before[i]], text[i]))
    return [rank[t] for t, ok in zip(text, live) if ok]


def _merge_together(data: np.ndarray, at: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many short slices: in each round every slice merges its leftmost lowest pair."""
    lengths = np.diff(at)
    width = int(lengths.max(initial=1))
    ids = np.zeros((len(lengths), width), np.int64)
    inside = np.arange(width) < lengths[:, None]
    ids[inside] = r.single[data]
    counts = lengths.copy()
    rank = np.full((len(lengths), width), NEVER, np.int64)
    pairs = np.arange(width - 1) < (counts - 1)[:, None]
    left, right = ids[:, :-1][pairs], ids[:, 1:][pairs]
    rank[:, :-1][pairs] = r.merged(left, right)
    out = ids
    rows = np.arange(len(lengths))
    while len(rows):
        best = rank.argmin(axis=1)
        number = rank[np.arange(len(rows)), best]
        done = number == NEVER
        if done.any():
            out_rows = rows[done]
            out[out_rows, : ids.shape[1]] = ids[done]
            keep = ~done
            rows, ids, rank, best, number = rows[keep], ids[keep], rank[keep], best[keep], number[keep]
            if not len(rows):
                break
            need = int(counts[rows].max())
            ids, rank = ids[:, :need], rank[:, :need]
        column = np.arange(ids.shape[1])
        source = np.minimum(column + (column > best[:, None]), ids.shape[1] - 1)
        ids, rank = np.take_along_axis(ids, source, axis=1), np.take_along_axis(rank, source, axis=1)
        counts[rows] -= 1
        n = np.arange(len(rows))
        ids[n, best] = number
        rank[n, np.minimum(counts[rows] - 1, ids.shape[1] - 1)] = NEVER
        rank[:, -1] = NEVER
        to_right = best < counts[rows] - 1
        k = n[to_right]
        rank[k, best[k]] = r.merged(ids[k, best[k]], ids[k, best[k] + 1])
        alone = n[~to_right]
        rank[alone, best[alone]] = NEVER
        k = n[best > 0]
        rank[k, best[k] - 1] = r.merged(ids[k, best[k] - 1], ids[k, best[k]])
    flat = out[np.arange(width) < counts[:, None]]
    return flat, np.concatenate([[0], np.cumsum(counts)])


def encode_slices(distinct: pa.BinaryArray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct slice, flat with offsets. A slice that is a token is that token."""
    data, at = text_bytes(distinct)
    lengths = np.diff(at)
    counts = np.ones(len(distinct), np.int64)
    strings = distinct.to_pylist()
    whole = np.array([r.rank.get(s, -1) for s in strings], np.int64)
    order, pieces = [], []
    known = np.flatnonzero(whole >= 0)
    order.append(known)
    pieces.append((whole[known], np.ones(len(known), np.int64)))
    for low, high in ((1, 8), (9, 16), (17, LONG_SLICE)):
        group = np.flatnonzero((whole < 0) & (lengths >= low) & (lengths <= high))
        for begin in range(0, len(group), 1 << 16):
            part = group[begin : begin + (1 << 16)]
            sizes = lengths[part]
            ends = np.cumsum(sizes)
            source = np.repeat(at[part] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            ids, bounds = _merge_together(data[source], np.concatenate([[0], ends]), r)
            order.append(part)
            pieces.append((ids, np.diff(bounds)))
    for k in np.flatnonzero((whole < 0) & (lengths > LONG_SLICE)):
        ids = np.array(_merge_alone(strings[k], r), np.int64)
        order.append(np.array([k]))
        pieces.append((ids, np.array([len(ids)])))
    where, flat, sizes = np.concatenate(order), np.concatenate([p for p, _ in pieces]), np.concatenate([s for _, s in pieces])
    counts[where] = sizes
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(bounds[-1]), np.int64)
    ends = np.cumsum(sizes)
    out[np.repeat(bounds[where] - (ends - sizes), sizes) + np.arange(len(flat))] = flat
    return out, bounds


def encode_texts(data: np.ndarray, at: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids of all texts (flat), their bounds by text, and (codes, first, distinct ids, bounds) for digests."""
    starts, first = pre_tokens(data, at)
    coded = slices(data, starts, np.append(starts[1:], len(data))).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, bounds = encode_slices(coded.dictionary, r)
    sizes = bounds[codes + 1] - bounds[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = ids[np.repeat(bounds[codes] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
    return flat, ends[first], (codes, first, ids, bounds)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Every input column plus ``out``: the token ids of ``text`` (array<int>) by the ranks in ``path``,
    without special tokens. Null and empty texts get an empty array. A column named ``out`` is replaced.
    No shuffle; memory follows one chunk of texts."""
    from pyspark.sql import types as T

    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for rows, data, at in chunks(batches, text, CHUNK):
            flat, bounds, _ = encode_texts(data, at, r)
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, made], names=[*rows.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every input column plus ``out``: the bytes (binary) of the token ids; null and empty arrays give empty bytes."""
    from pyspark.sql import types as T

    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([r.decode(np.asarray(x or [], np.int64)).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pre_tokens long"


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_pre_tokens: encode and decode in one pass over the texts.
    A null text counts as empty (0 tokens, digest of nothing); repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        for rows, data, at in chunks(batches, text, CHUNK):
            flat, bounds, (codes, first, ids, by_slice) = encode_texts(data, at, r)
            numbers = list(map(str, ids.tolist()))
            cut = by_slice.tolist()
            said = np.array([" ".join(numbers[cut[k] : cut[k + 1]]) for k in range(len(cut) - 1)] or [""], object)
            words = said[codes] if len(codes) else said[:0]
            decoded = r.decode(flat)
            ends = np.concatenate([[0], np.cumsum(r.token_at[flat + 1] - r.token_at[flat])])[bounds]
            in_ids, in_bytes = [], []
            for k in range(rows.num_rows):
                in_ids.append(hashlib.sha256(" ".join(words[first[k] : first[k + 1]].tolist()).encode()).hexdigest())
                in_bytes.append(hashlib.sha256(decoded[ends[k] : ends[k + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(bounds)), pa.array(in_ids), pa.array(in_bytes), pa.array(np.diff(first).astype(np.int64))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pre_tokens"],
            )

    return docs.select(key, text).mapInArrow(run, DIGESTS)
