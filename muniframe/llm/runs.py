"""Runs of repeated words: maximal stretches of a text whose words come back after a fixed period.

Runs are read off maximal pairs. A pair of places i < j of a text is maximal when the words before them differ and their
common continuation cannot be prolonged. If its length reaches ``(exponent - 1)`` times the distance j - i, the
stretch from i to the end of j's continuation is periodic with that distance and no neighbouring word extends it: the
pair is the run, there is nothing left to extend. Multiples of a period give the same stretch, so the least distance
of a stretch is its period.

The pairs come from the tree of LCP intervals of a suffix array, walked from the leaves up. An interval holds its places in text order
and lists their classes, the words on their left. Where two parts of an interval are joined, places of different classes that become
neighbours and lie near enough are maximal pairs. Neighbours are enough: a place between the two would make the period
smaller. Parts of one common class are joined without a look. Smaller parts go into larger ones.

Two cuts that lose nothing come first. A pair needs ``least`` equal words, so the suffix array is built over the groups
of so many words that their text has twice. And a place whose longest repeat is shorter than ``exponent - 1`` times the distance to the
next equal group is in no pair. All of it happens within a text, so texts are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import BLANKS, Words, chunks, mask_of

MIN_LENGTH, EXPONENT = 6, 4
#: Text bytes handled at once; the arrays beside them take about 30 times as much.
CHUNK = 4 << 20

INSIDE = ~mask_of(BLANKS)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's number among the distinct ones, and how many there are."""
    found = pa.array(key).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def word_groups(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The number of the ``size`` words from each place on, equal only within a text; -1 where the text ends before, or has
    this group once."""
    n = len(codes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(n) >= size)
    out = np.full(n, -1, np.int64)
    if not len(whole):
        return out
    number, many = _numbered(text[whole] * (int(codes.max()) + 1) + codes[whole])
    for k in range(1, size):
        number, many = _numbered(number * (int(codes.max()) + 1) + codes[whole + k])
    twice = np.bincount(number, minlength=many)[number] > 1
    out[whole[twice]] = _numbered(number[twice])[0] if twice.any() else 0
    return out


def suffixes(letter: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``letter[i:stop[i]]`` and the common prefix of each with the one before it.

    Ranks double their depth each round, and only suffixes that still share a rank take part; the ranks of every
    round then give the common prefixes, longest step first."""
    n = len(letter)
    order = np.argsort(letter, kind="stable")
    new = np.append(True, letter[order[1:]] != letter[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # slots of the order that share their rank
        if not len(tied):
            break
        own = order[tied]
        beyond = own + depth
        second = np.where(beyond < stop[own], rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[own]))
        own, second = own[by], second[by]
        fresh = np.append(True, (rank[own[1:]] != rank[own[:-1]]) | (second[1:] != second[:-1]))
        if not (fresh & ~new[tied]).any():
            break  # what is tied now is equal to its end
        order[tied], new[tied] = own, fresh
        rank = rank.copy()
        rank[own] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        levels.append(rank.astype(np.int32))
        depth *= 2
    a, b = order[1:], order[:-1]
    room = np.minimum(stop[a] - a, stop[b] - b)
    same = np.where(rank[a] == rank[b], room, 0)
    for k in range(len(levels) - 1, -1, -1):
        open_ = np.flatnonzero(same < room)
        hit = levels[k][a[open_] + same[open_]] == levels[k][b[open_] + same[open_]]
        same[open_[hit]] += 1 << k
    return order, np.append(0, np.minimum(same, room))


class Places:
    """Places of an interval in text order, in blocks, so that a place is put in without moving all others."""

    BLOCK = 2000

    def __init__(self, place: int, left: int):
        self.blocks, self.heads, self.size, self.classes = [[place]], [place], 1, {left}

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def put(self, place: int) -> tuple[int | None, int | None]:
        """The neighbours that a new place gets."""
        k = max(bisect_left(self.heads, place) - 1, 0)
        block = self.blocks[k]
        at = bisect_left(block, place)
        before = block[at - 1] if at else None
        after = block[at] if at < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        block.insert(at, place)
        self.heads[k] = block[0]
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.heads[k : k + 1] = [block[0], block[half]]
        self.size += 1
        return before, after


class Pairs:
    """The walk over one suffix array: ``found`` gets (start, end, period) of every maximal pair that is a stretch long enough."""

    def __init__(self, left: list[int], min_length: int, exponent: int):
        self.left, self.min_length, self.times = left, min_length, exponent - 1
        self.found: dict[tuple[int, int], int] = {}

    def _pair(self, i: int, j: int, depth: int) -> None:
        period = j - i
        if depth >= self.times * period and depth + period >= self.min_length and self.left[i] != self.left[j]:
            key = (i, j + depth)
            if self.found.get(key, period) >= period:
                self.found[key] = period

    def join(self, a: Places, b: Places, depth: int) -> Places:
        if a.size < b.size:
            a, b = b, a
        look = len(a.classes) > 1 or a.classes != b.classes
        own = None  # the place put in last: it is of the same part
        for place in b:
            before, after = a.put(place)
            if look:
                if before is not None and before != own:
                    self._pair(before, place, depth)
                if after is not None:
                    self._pair(place, after, depth)
            own = place
        a.classes |= b.classes
        return a

    def walk(self, order: list[int], common: list[int], least: int) -> None:
        """Intervals from the leaves up; ``common[k]`` is the common prefix of the suffixes k - 1 and k."""
        stack: list[tuple[int, Places]] = []
        last: Places | None = None
        for k in range(len(order) + 1):
            depth = common[k] if k < len(order) else 0
            while stack and stack[-1][0] > depth:
                above, part = stack.pop()
                last = self.join(part, last, above)
            if depth < least:
                stack.clear()
            elif stack and stack[-1][0] == depth:
                stack[-1] = (depth, self.join(stack[-1][1], last, depth))
            else:
                stack.append((depth, last))
            if k < len(order):
                last = Places(order[k], self.left[order[k]])


def _longest_least(min_length: int, exponent: int) -> int:
    """The shortest continuation that a pair of a run can have."""
    return min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))


def _next_equal(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distance from each place to the nearest other place of its group."""
    by = np.lexsort((places, group[places]))
    at = places[by]
    same = group[at[1:]] == group[at[:-1]]
    gap = np.where(same, np.diff(at), np.iinfo(np.int64).max)
    near = np.minimum(np.append(gap, np.iinfo(np.int64).max), np.append(np.iinfo(np.int64).max, gap))
    out = np.empty(len(places), np.int64)
    out[by] = near
    return out


def runs_of(codes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. ``codes`` are the words of all texts, numbered so that equal words have
    equal numbers; text k has the words ``first[k]`` to ``first[k + 1]``; starts and ends count through all texts."""
    none = np.empty((0, 3), np.int64)
    least = _longest_least(min_length, exponent)
    group = word_groups(codes, first, least)
    places = np.flatnonzero(group >= 0)
    if not len(places):
        return none
    near = _next_equal(group, places)
    # The suffix array is over the groups that occur twice; a stretch of successive ones is a string.
    breaks = np.append(np.diff(places) > 1, True)
    stop = np.flatnonzero(breaks)[np.cumsum(np.append(0, breaks[:-1]))] + 1
    order, common = suffixes(group[places], stop)
    common = np.where(common > 0, common + least - 1, 0)
    longest = np.maximum(common, np.append(common[1:], 0))
    # A place takes part only if a repeat of it reaches (exponent - 1) times the least distance.
    keep = longest // (exponent - 1) >= near[order]
    if not keep.any():
        return none
    kept = np.flatnonzero(keep)
    common = np.minimum.reduceat(common[: kept[-1] + 1], np.append(0, kept[:-1] + 1))  # least common prefix since the last kept one
    order = places[order[kept]]
    left = np.full(len(codes), -1, np.int64)
    left[1:] = codes[:-1]
    left[first[:-1][np.diff(first) > 0]] = -1
    pairs = Pairs(left.tolist(), min_length, exponent)
    pairs.walk(order.tolist(), common.tolist(), least)
    if not pairs.found:
        return none
    rows = np.array([(*span, period) for span, period in pairs.found.items()], np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _joined(data: np.ndarray, words: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, one blank between them."""
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
    owner = words.text_of()[kept]
    room = sizes + 1
    room[np.append(owner[1:] != owner[:-1], True)[: len(room)]] -= 1  # none after a text's last word
    bounds = np.append(0, np.cumsum(room))
    out = np.full(int(bounds[-1]), 0x20, np.uint8)
    inside = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
    target = np.repeat(bounds[:-1] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
    out[target] = data[inside]
    at = bounds[np.searchsorted(owner, np.arange(len(words.first)))]
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


RUNS = "n_words long, runs array<struct<start: long, period: long, length: long>>, collapsed string"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``key``, n_words, runs and collapsed, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds start, smallest period and length of every stretch of at least ``min_length``
    words and ``exponent`` periods that no neighbouring word extends, by start, then period. ``collapsed`` is the text's words
    with one blank between them, less those that some run holds after its first period.

    Null, empty and blank texts: no words, no runs, an empty ``collapsed``. A null key stays null, a repeated row is a row of
    its own. Other columns are left out. A text of any length is one chunk: some 100 bytes of arrays a word."""
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
        for rows, data, at in chunks(batches, "text", CHUNK):
            words = Words(data, at, INSIDE[data])
            found = runs_of(words.codes, words.first, min_length, exponent)
            start, end, period = found.T
            owner = np.searchsorted(words.first, start, side="right") - 1
            step = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, end, -1)
            collapsed = _joined(data, words, np.cumsum(step[:-1]) == 0)
            many = np.bincount(owner, minlength=rows.num_rows)
            structs = pa.StructArray.from_arrays([pa.array(start - words.first[owner]), pa.array(period), pa.array(end - start)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.per_text), lists, collapsed], names=["key", "n_words", "runs", "collapsed"])

    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, {RUNS}").withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of equal ones the first by start, then period.
    Null without runs."""
    by_strength = F.array_sort(
        runs,
        lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1))
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0),
    )
    return F.get(by_strength, F.lit(0))
