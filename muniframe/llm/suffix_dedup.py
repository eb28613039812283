"""Removal of byte strings of ``SPAN`` bytes that start anywhere else too, by suffix arrays.

Winnowing cuts the work: every window of SPAN bytes picks the least hash among its K-grams, its anchor, so
equal windows have equal anchors at equal offsets. A run of windows of one text with one anchor is a stretch.
Stretches meet by anchor hash:

* an anchor seen once has no repeat;
* stretches whose whole bytes are equal repeat as they are, and one of them stands for all;
* what is left differs somewhere, and a suffix array over the bytes of its anchor's stretches decides.

The suffix array is built in two stages: suffixes smaller than their successors are sorted directly, the
others are induced by one scan over the buckets of first bytes. Only suffixes that begin a window, or that one
of those needs for its induction, are in it. Common prefixes of neighbours mark windows that occur twice.

An anchor with more than HOT bytes of different stretches is split: its windows meet by their own hash instead, 200 bytes each.
A text longer than a chunk is cut into overlapping parts, which changes no window and no anchor.

Every row has a number of its own, so rows may share a doc_id or have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .batches import chunks, mixed, text_bytes
from .tables import packed_texts, stored

SPAN, K = 200, 100
#: Text bytes handled at once, and bytes of one suffix array; the arrays beside them take about 100 times as much.
CHUNK = 1 << 19
ARRAY_BYTES = 3 << 19
#: Bytes of different stretches from which an anchor's windows meet by their own hash.
HOT = 12 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_HASH = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any substring in constant time: prefix sums of a polynomial modulo 2**64, shifted back by its inverse."""

    def __init__(self, data: np.ndarray):
        self.back = _powers(INVERSE, len(data) + 1)
        self.run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_HASH[data] * _powers(BASE, len(data)), out=self.run[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.run[end] - self.run[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, at: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, hash of all bytes with the anchor's place) of every stretch."""
    empty = np.empty(0, np.int64)
    window = np.arange(max(0, len(data) - span + 1))
    text = np.searchsorted(at, window, side="right") - 1
    window = window[at[text + 1] - window >= span]
    if not len(window):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    width = span - k + 1
    rolling = Rolling(data)
    gram = np.arange(len(data) - k + 1)
    h = rolling.of(gram, gram + k)
    least = sliding_min(h, width)[window]
    text = np.searchsorted(at, window, side="right") - 1
    anchor = np.where(h[window + width - 1] == least, window + width - 1, -1)  # the newest one is least: the last of equals
    lost = np.ones(len(window), bool)
    lost[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    seek = np.flatnonzero(lost & (anchor < 0))
    for part in np.array_split(seek, max(1, len(seek) // 16384)):
        near = h[window[part][:, None] + np.arange(width)[::-1]]
        anchor[part] = window[part] + width - 1 - near.argmin(axis=1)
    anchor = np.maximum.accumulate(anchor)  # anchors never move back
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    low, high, p = window[first], window[last], anchor[first]
    whole = rolling.of(low, high + span) ^ mixed(((p - low) << 20 | (high - low)).astype(np.uint64))
    return text[first], low, high, h[p], whole


ANCHORS = "docs array<long>, firsts array<long>, many int, anchor long, whole long"


def parts(batches: Iterator[pa.RecordBatch], span: int = SPAN) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """(docs, bytes, offsets, bytes of the text in front): chunks of texts, a long text in parts that overlap by ``span`` - 1 bytes."""
    for rows, data, at in chunks(batches, "text", CHUNK):
        if rows.num_rows > 1 or len(data) <= CHUNK:
            yield rows.column(0), data, at, 0
            continue
        for begin in range(0, len(data) - span + 1, CHUNK):
            part = data[begin : begin + CHUNK + span - 1]
            yield rows.column(0), part, np.array([0, len(part)]), begin


def anchors(docs: DataFrame) -> DataFrame:
    """Stretches of all texts (columns doc, text), the equal ones of a chunk as one row: their texts and first windows,
    the number of windows after the first, and both hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, at, front in parts(batches):
            text, low, high, anchor, whole = stretches(data, at)
            if not len(text):
                continue
            by = np.lexsort((whole, anchor))
            anchor, whole, text, low, many = anchor[by], whole[by], text[by], low[by], (high - low)[by]
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
            bounds = pa.array(np.append(new, len(by)), pa.int32())
            made = [
                pa.ListArray.from_arrays(bounds, doc.take(pa.array(text))), pa.ListArray.from_arrays(bounds, pa.array(low - at[text] + front)),
                pa.array(many[new].astype(np.int32)), pa.array(anchor[new].view(np.int64)), pa.array(whole[new].view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["docs", "firsts", "many", "anchor", "whole"])

    return docs.select("doc", "text").mapInArrow(run, ANCHORS)


EQUAL, ASK, ASK_WINDOWS = 0, 1, 2
VERDICTS = ["doc", "first", "many", "anchor", "kind"]


def _verdict(doc, first, many, anchor, kind: int) -> pa.RecordBatch:
    columns = [pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(many, pa.int32()), pa.array(anchor, pa.int64()), pa.array(np.full(len(doc), kind), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=VERDICTS)


def _bytes(rows: np.ndarray) -> int:
    return int(rows[:, 2].sum()) + SPAN * len(rows)


class Asking:
    """One stretch of each kind, collected by anchor. An anchor with several kinds asks a suffix array about all of them;
    with over ``hot`` bytes of them it asks about their windows, which are passed on as they come."""

    def __init__(self, hot: int):
        self.hot, self.held, self.size, self.crowded = hot, [], 0, None

    def take(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``rows``: (doc, first, many, anchor) by row, sorted by anchor."""
        if not len(rows):
            return
        self.held.append(rows)
        self.size += _bytes(rows)
        if rows[0, 3] != rows[-1, 3] or self.held[0][0, 3] != rows[-1, 3] or self.size > self.hot:
            yield from self._flush(rows[-1, 3])

    def _flush(self, open_anchor) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(self.held) if self.held else np.empty((0, 4), np.int64)
        many = rows[:, 3] == self.crowded if self.crowded is not None else np.zeros(len(rows), bool)
        ends = open_anchor is not None and rows[:, 3] == open_anchor
        still = np.asarray(ends) & ~many if open_anchor is not None else np.zeros(len(rows), bool)
        if _bytes(rows[still]) > self.hot:
            self.crowded = open_anchor
            many, still = many | still, np.zeros(len(rows), bool)
        closed = rows[~many & ~still]
        if len(closed):
            _, number, count = np.unique(closed[:, 3], return_inverse=True, return_counts=True)
            yield _verdict(*closed[count[number] > 1].T, ASK)
        if many.any():
            yield _verdict(*rows[many].T, ASK_WINDOWS)
        self.held = [rows[still]] if still.any() else []
        self.size = _bytes(rows[still])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush(None)


def sorted_out(found: DataFrame, hot: int = HOT) -> DataFrame:
    """Each stretch that others equal as EQUAL (all its bytes repeat); one stretch of every kind, if its anchor has other
    kinds, as ASK (a suffix array has to tell) or, if it has over ``hot`` bytes of them, as ASK_WINDOWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, before = Asking(hot), None
        waiting: pa.RecordBatch | None = None

        def settle(rows: pa.RecordBatch, next_kind) -> Iterator[pa.RecordBatch]:
            nonlocal before
            many, anchor, whole = (np.asarray(rows.column(k)) for k in (2, 3, 4))
            sizes = np.asarray(pc.list_value_length(rows.column(0)))
            docs, firsts = (np.asarray(rows.column(k).flatten()) for k in (0, 1))
            same = np.zeros(len(anchor) + 1, bool)
            same[1:-1] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
            same[0] = before == (anchor[0], whole[0])
            same[-1] = next_kind == (anchor[-1], whole[-1])
            equal = np.repeat((sizes > 1) | same[:-1] | same[1:], sizes)
            if equal.any():
                yield _verdict(docs[equal], firsts[equal], np.repeat(many, sizes)[equal], np.zeros(int(equal.sum()), np.int64), EQUAL)
            lead = (np.cumsum(sizes) - sizes)[~same[:-1]]
            yield from asking.take(np.stack([docs[lead], firsts[lead], many[~same[:-1]], anchor[~same[:-1]]], axis=1))
            before = (anchor[-1], whole[-1])

        for batch in batches:
            if batch.num_rows:
                if waiting is not None:
                    yield from settle(waiting, (batch.column(3)[0].as_py(), batch.column(4)[0].as_py()))
                waiting = batch
        if waiting is not None:
            yield from settle(waiting, None)
        yield from asking.close()

    ordered = found.repartition("anchor").sortWithinPartitions("anchor", "whole")
    return ordered.mapInArrow(run, "doc long, first long, many int, anchor long, kind int")


# ---- suffix array -------------------------------------------------------------------------------


def words_at(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer; zeros beyond the end of its string."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    left = ends - np.arange(len(data))
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | np.where(left > k, padded[k : k + len(data)], np.uint64(0))
    return out


def smaller_than_next(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; ``last`` flags the final byte of each string (never smaller)."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[last] = -1
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def directly_sorted(places: np.ndarray, word: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """Suffixes in order of their first ``span`` bytes: by eight bytes at a time, only ties going on."""
    if not len(places):
        return places
    order = places[np.argsort(word[places], kind="stable")]
    key = word[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    for depth in range(8, span, 8):
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        own = order[tied]
        group = np.cumsum(new[tied])
        beyond = own + depth
        key = np.where(beyond < ends[own], word[np.minimum(beyond, len(word) - 1)], np.uint64(0))
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        order[tied], key = own[by], key[by]
        first = new[tied]
        first[1:] |= key[1:] != key[:-1]
        new[tied] = first
    return order


def induced(small: np.ndarray, rest: np.ndarray, data: np.ndarray, starts: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """The suffix array from its sorted small suffixes: one scan over the buckets of first bytes. Each bucket puts the
    predecessors of its entries, in order, at the head of their own buckets. ``rest`` flags the suffixes to induce,
    ``starts`` the first bytes of strings, ``closing`` holds the final bytes to induce (their successor is the empty suffix)."""
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = data[small]
    bounds = np.searchsorted(first, np.arange(257))
    for byte in np.unique(data[closing]).tolist():
        heads[byte].append(closing[data[closing] == byte])
    out = []

    def before(entries: np.ndarray) -> np.ndarray:
        entries = entries[~starts[entries]] - 1
        return entries[rest[entries]]

    for byte in range(256):
        bucket = heads[byte]
        wave = np.concatenate(bucket) if bucket else small[:0]
        bucket = [wave]
        while len(wave):  # runs of one byte stay in this bucket
            wave = before(wave)
            wave = wave[data[wave] == byte]
            bucket.append(wave)
        entries = np.concatenate([*bucket, small[bounds[byte] : bounds[byte + 1]]])
        if not len(entries):
            continue
        out.append(entries)
        wave = before(entries)
        wave = wave[data[wave] > byte]
        letter = data[wave]
        wave = wave[np.argsort(letter, kind="stable")]
        letter = np.sort(letter)
        for k in np.unique(letter).tolist():
            heads[k].append(wave[np.searchsorted(letter, k) : np.searchsorted(letter, k, side="right")])
    return np.concatenate(out) if out else small


def common_prefixes(order: np.ndarray, word: np.ndarray, span: int) -> np.ndarray:
    """Common prefix of each entry with the one before it, at most ``span``; every entry has ``span`` bytes. The first has 0."""
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for depth in range(0, span, 8):
        a, b = word[order[open_] + depth], word[order[open_ - 1] + depth]
        differ = a ^ b
        out[open_] = depth + sum(((differ >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(8))
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return np.minimum(out, span)


def repeated(data: np.ndarray, at: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Flags of the positions whose next ``span`` bytes, inside their string, begin at another position too."""
    n = len(data)
    flags = np.zeros(n, bool)
    sizes = np.diff(at)
    ends = np.repeat(at[1:], sizes)
    wanted = ends - np.arange(n) >= span
    if wanted.sum() < 2:
        return flags
    full = at[:-1][sizes > 0]
    starts, last = np.zeros(n, bool), np.zeros(n, bool)
    starts[full] = True
    last[at[1:][sizes > 0] - 1] = True
    small = smaller_than_next(data, last)
    # what an induction rests on: from each wanted suffix on to the next small one, or to the end
    here = np.arange(n)
    stop = np.minimum.accumulate(np.where(small | last, here, n)[::-1])[::-1]
    reach = np.maximum.accumulate(np.where(wanted, stop, -1))
    used = here <= reach
    word = words_at(data, ends)
    sorted_small = directly_sorted(np.flatnonzero(small & used), word, ends, span)
    order = induced(sorted_small, used & ~small, data, starts, np.flatnonzero(last & used & ~small))
    order = order[wanted[order]]
    same = common_prefixes(order, word, span) >= span
    flags[order[same]] = True
    flags[order[np.flatnonzero(same) - 1]] = True
    return flags


# ---- whole job ----------------------------------------------------------------------------------


def pieces(docs: DataFrame, asked: DataFrame, span: int = SPAN) -> DataFrame:
    """(meet, doc, first, piece): the bytes of the asked stretches, or of their windows, and the key under which they meet."""
    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("first", "many", "anchor", "kind")).alias("asks"))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["meet", "doc", "first", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, packed, asks in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc, text = doc.as_py(), open_up(packed.as_buffer())
                for ask in asks.as_py():
                    first, many = ask["first"], ask["many"]
                    if ask["kind"] == ASK:
                        out.append((ask["anchor"], doc, first, text[first : first + many + span]))
                        size += many + span
                    else:
                        begin = np.arange(many + 1)
                        own = Rolling(np.frombuffer(text[first : first + many + span], np.uint8)).of(begin, begin + span)
                        out += [(h, doc, k, text[k : k + span]) for k, h in zip((begin + first).tolist(), own.view(np.int64).tolist())]
                        size += span * (many + 1)
                    if size > ARRAY_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return packed_texts(docs).join(per_doc, "doc").mapInArrow(run, "meet long, doc long, first long, piece binary")


def decided(met: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, begin, end) of the repeated strings among pieces, by suffix arrays over all pieces that meet."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        doc, first = np.asarray(table["doc"]), np.asarray(table["first"])
        data, at = text_bytes(table["piece"].combine_chunks())
        hit = repeated(data, at, span)
        new = hit.copy()
        new[1:] &= ~hit[:-1]
        new[at[:-1]] = hit[at[:-1]]
        begin = np.flatnonzero(new)
        owner = np.searchsorted(at, begin, side="right") - 1
        stop = np.flatnonzero(~np.append(hit, False))
        end = np.minimum(stop[np.searchsorted(stop, begin)], at[owner + 1])
        offset = first[owner] - at[owner]
        made = [pa.array(doc[owner]), pa.array(begin + offset), pa.array(end - 1 + span + offset)]
        return pa.RecordBatch.from_arrays(made, names=["doc", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.get_total_buffer_size()
            if size < ARRAY_BYTES:
                continue
            table = pa.Table.from_batches(held)
            meet = np.asarray(table["meet"])
            whole = int(np.searchsorted((meet != meet[-1])[::-1], True))
            cut = len(meet) - whole
            if cut:
                yield spans(table.slice(0, cut))
            rest = table.slice(cut)
            if not cut and pc.all(pc.equal(pc.binary_length(rest["piece"]), span)).as_py():
                yield spans(rest)  # single windows: one of each kind stands for those to come
                coded = rest["piece"].combine_chunks().dictionary_encode()
                rest = rest.take(pa.array(np.unique(np.asarray(coded.indices), return_index=True)[1]))
            held, size = rest.to_batches(), rest.nbytes
        if held:
            yield spans(pa.Table.from_batches(held))

    return met.repartition("meet").sortWithinPartitions("meet").mapInArrow(run, "doc long, begin long, end long")


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; spans that touch make one run."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def kept_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): every text without its spans."""
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, cuts in zip(batch.column(2), batch.column(3)):
                text, cuts = open_up(packed.as_buffer()), cuts.values
                if cuts is None or not len(cuts):
                    rows.append((len(text), 0, 0, text))
                    continue
                begin, end = merged(np.asarray(cuts.field(0)), np.asarray(cuts.field(1)))
                stays = zip([0, *end.tolist()], [*begin.tolist(), len(text)])
                rows.append((len(text), int((end - begin).sum()), len(begin), b"".join(text[a:b] for a, b in stays)))
            made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(1), *made], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["key"].dataType.simpleString()
    return packed_texts(docs, "key").join(per_doc, "doc", "left").select("doc", "key", "packed", "cuts").mapInArrow(run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary), one row per input row.

    Null and empty texts and texts under SPAN bytes keep all they have. A repeated row is a text of its own, so both
    lose all that is long enough; rows may share a doc_id, and a null one stays null. ``kept`` may be cut inside a character. Texts may be of any length
    that fits a row."""
    own = stored(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("key"), F.col(text).alias("text")))
    found = stored(sorted_out(anchors(own), hot))
    asked = found.where(F.col("kind") != EQUAL)
    equal = found.where(F.col("kind") == EQUAL).select("doc", F.col("first").alias("begin"), (F.col("first") + F.col("many") + F.lit(SPAN)).alias("end"))
    told = stored(decided(pieces(own, asked)))
    out = kept_bytes(own, equal.union(told))
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
