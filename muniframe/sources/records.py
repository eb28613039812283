"""Records of delimited text files, read in splits of any file.

A record ends at a line break outside quotes, and whether a place is inside quotes depends on all that comes before it. So
the reader is an automaton over a file: at a line border it is outside quotes or inside a quoted cell, and what a line
does to that state depends on the delimiter, because a quote opens a cell only where a cell begins. The effect of a stretch of
lines is a function from state to state, and functions compose:

* one scan cuts every split into chunks of lines and stores each with its effect from either state and under every delimiter that
  may be the file's, and with the number of records that begin in it;
* the delimiter is decided from the file's first 8 KiB, the functions are composed along the file, and every chunk learns its
  state at entry, its first record number, and where the record that it leaves open ends;
* every chunk is parsed by itself: lines that end an earlier record go to the chunk that has its beginning.

Rules of quoting are those of Python's ``csv`` reader, malformed cells included. Only sizes and states are shuffled, and
the text of records that cross a border.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stored

#: Bytes of a chunk (whole lines), characters that decide a delimiter.
CHUNK, SAMPLE = 4 << 20, 8192
#: Chunks whose places are sent to every executor; beyond, places and chunks meet by a shuffle.
BROADCAST_CHUNKS = 100_000
PLACE = ["path", "block", "chunk"]

START, FIELD, QUOTED, CLOSED = range(4)
_AT_QUOTE = {START: QUOTED, FIELD: FIELD, QUOTED: CLOSED, CLOSED: QUOTED}


def lines_of(text: str) -> list[str]:
    """Lines with their ends; ``\\n``, ``\\r`` and ``\\r\\n`` end one."""
    return list(io.StringIO(text, newline=""))


def left_quoted(line: str, delimiter: str, quoted: bool) -> bool:
    """Whether a line that begins inside quotes (or not) ends inside."""
    if '"' not in line:
        return quoted
    state = QUOTED if quoted else START
    for k, part in enumerate(line.split('"')):
        if k:
            state = _AT_QUOTE[state]
        if part and state != QUOTED:
            state = START if part.endswith(delimiter) else FIELD
    return state == QUOTED


def effect(lines: list[str], delimiter: str, quoted: bool, opens_file: bool = False) -> tuple[bool, int, int]:
    """(inside quotes at the end, records that begin, characters that belong to a record from before) of lines entered in a state.

    Blank lines outside quotes are no records, but for a file's first line."""
    full = [0, *accumulate(int(x not in ("\n", "\r", "\r\n")) for x in lines)]
    if opens_file and lines and full[1] == 0:
        full = [0, *(n + 1 for n in full[1:])]
    upto = [0, *accumulate(map(len, lines))]
    begun, at, lead = 0, 0, None if quoted else 0
    for k, line in enumerate(lines):
        if '"' not in line:
            continue
        now = left_quoted(line, delimiter, quoted)
        if not quoted:
            begun += full[k + 1] - full[at]
        elif not now and lead is None:
            lead = upto[k + 1]
        quoted, at = now, k + 1
    if not quoted:
        begun += full[-1] - full[at]
    return quoted, begun, upto[-1] if lead is None else lead


def _first_record(lines: list[str], delimiter: str) -> str:
    """The text of the record that opens a file, as far as these lines go."""
    quoted = False
    for k, line in enumerate(lines):
        quoted = left_quoted(line, delimiter, quoted)
        if not quoted:
            return "".join(lines[: k + 1])
    return "".join(lines)


#: Values of an Arrow column that are Python objects at a time.
AT_ONCE = 64


def _values(column: pa.Array, a: int, b: int) -> Iterator[object]:
    """The values a .. b - 1 of a column, without a list of all of them."""
    for k in range(a, b, AT_ONCE):
        yield from column.slice(k, min(AT_ONCE, b - k)).to_pylist()


def in_chunks(batches: Iterator[pa.RecordBatch], end: bytes, limit: int) -> Iterator[tuple[tuple[str, int, int], int, bytes]]:
    """((path, size, block), number of the chunk in its split, bytes) from batches of (path, size, block, value): values that follow each other in
    a split, each with its ``end``, up to about ``limit`` bytes. Of a batch, a few values at a time become Python objects."""
    at, number, held, weight = None, 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.asarray(batch.column(0).dictionary_encode().indices)
        block = np.asarray(batch.column(2))
        bounds = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            here = tuple(batch.column(k)[a].as_py() for k in range(3))
            if here != at:
                if held:
                    yield at, number, b"".join(held)
                at, number, held, weight = here, 0, [], 0
            for value in _values(batch.column(3), a, b):
                held += (value, end)
                weight += len(value) + 1
                if weight >= limit:
                    yield at, number, b"".join(held)
                    number, held, weight = number + 1, [], 0
    if held:
        yield at, number, b"".join(held)


CHUNKS = (
    "path string, size long, block long, chunk int, chars long, bytes long, text string, head string, "
    "exits array<boolean>, begun array<long>, leads array<long>, firsts array<string>"
)


def chunks_of(spark: SparkSession, paths: str | Sequence[str], encoding: str, delimiters: Sequence[str]) -> DataFrame:
    """All files in chunks, stored. ``exits``, ``begun`` and ``leads`` hold the effect under each delimiter, from outside and
    from inside quotes; ``firsts`` a file's first record under each delimiter."""
    lines = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    raw = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    delimiters, names = list(delimiters), [c.split()[0] for c in CHUNKS.split(", ")]

    def row(path: str, size: int, block: int, chunk: int, data: bytes) -> tuple:
        text = data.decode(encoding, "replace")
        lines, opens = lines_of(text), block == 0 and chunk == 0
        effects = [effect(lines, d, quoted, opens) for d in delimiters for quoted in (False, True)]
        firsts = [_first_record(lines, d) for d in delimiters] if opens else None
        return path, size, block, chunk, len(text), len(data), text, text[:SAMPLE], *map(list, zip(*effects)), firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("chunk", pa.int32()), ("chars", pa.int64()), ("bytes", pa.int64()),
                            ("text", pa.string()), ("head", pa.string()), ("exits", pa.list_(pa.bool_())), ("begun", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())), ("firsts", pa.list_(pa.string()))])
        made = lambda r: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, schema)], names=names)
        for (path, size, block), number, data in in_chunks(batches, b"\n", CHUNK):
            yield made(row(path, size, block, number, data))

    return stored(raw.mapInArrow(run, CHUNKS))


def _sniffed(samples: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """(path, d): the number of the delimiter that a file's beginning shows, null where it shows none."""
    delimiters = list(delimiters)

    def guess(sample: str) -> int | None:
        try:
            return delimiters.index(csv.Sniffer().sniff(sample, "".join(delimiters)).delimiter)
        except (csv.Error, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guess(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["path", "d"])

    return samples.mapInArrow(run, "path string, d int")


def _entry(exits_out: Column, exits_in: Column, before: Window) -> Column:
    """The state before each row: a file begins outside; a row that leaves either state in one resets, one that turns both swaps."""
    reset, swap = exits_out == exits_in, (exits_out & ~exits_in).cast("int")
    turned = F.coalesce(F.sum(swap).over(before), F.lit(0))
    at_reset = F.last(F.when(reset, turned), True).over(before)
    base = F.last(F.when(reset, exits_out.cast("int")), True).over(before)
    return F.pmod(F.coalesce(base, F.lit(0)) + turned - F.coalesce(at_reset, F.lit(0)), F.lit(2)) == 1


def places_of(chunks: DataFrame, delimiters: Sequence[str], default: Column | None = None) -> DataFrame:
    """For each chunk, stored: delimiter, skip (characters that end an earlier record), before (records that began earlier in the file), begun, tail
    (what later chunks add to its last record), opens (it begins its file), cut (its last line has no end) and header (the file's first record).

    One row a chunk goes through windows by file."""
    order = Window.partitionBy("path").orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    facts = chunks.drop("text", "head")
    if len(delimiters) > 1:
        length = F.sum("chars").over(whole) - (F.sum("bytes").over(whole) > F.col("size")).cast("int")
        heads = chunks.select(*PLACE, "head", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("seen"), length.alias("length")).where(F.col("seen") < SAMPLE)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk", "head"))), lambda x: x["head"]), "")
        begins = heads.groupBy("path").agg(joined.alias("text"), F.least(F.lit(SAMPLE), F.max("length")).cast("int").alias("length"))
        chosen = _sniffed(begins.select("path", F.substring("text", F.lit(1), F.col("length")).alias("sample")), delimiters)
        fallback = F.lit(0) if default is None else F.array_position(F.array(*map(F.lit, delimiters)), default).cast("int") - 1
        facts = facts.join(chosen, "path").withColumn("d", F.coalesce("d", fallback))
    else:
        facts = facts.withColumn("d", F.lit(0))
    of = lambda c, quoted: F.get(c, 2 * F.col("d") + (quoted.cast("int") if isinstance(quoted, Column) else int(quoted)))
    facts = facts.withColumns({"out": of("exits", False), "in": of("exits", True)}).withColumn("entry", _entry(F.col("out"), F.col("in"), earlier))
    facts = facts.withColumns({"begun": of("begun", F.col("entry")), "skip": F.when(F.col("entry"), of("leads", F.lit(True))).otherwise(F.lit(0))})
    placed = stored(facts.select(
        *PLACE, "size", "chars", "entry", F.element_at(F.array(*map(F.lit, delimiters)), F.col("d") + 1).alias("delimiter"), "begun", "skip",
        F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before"), (F.row_number().over(order) == 1).alias("opens"),
        ((F.sum("bytes").over(whole) > F.col("size")) & F.lead("block").over(order).isNull()).alias("cut"),
        F.last(F.when(F.col("begun") > 0, F.struct("block", "chunk")), True).over(earlier).alias("owner"),
        F.when(F.col("entry"), F.col("in")).otherwise(F.col("out")).alias("goes_on"), F.get("firsts", F.col("d")).alias("first"),
    ))
    carried = _at_places(chunks.select(*PLACE, "text"), placed.where("skip > 0").select(*PLACE, "skip", "cut", "chars", "owner"))
    piece = F.substring("text", F.lit(1), F.when(F.col("cut") & (F.col("skip") == F.col("chars")), F.col("skip") - 1).otherwise(F.col("skip")).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "chunk", piece.alias("piece"))))
    tails = carried.groupBy("path", "owner.block", "owner.chunk").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("tail"))
    placed = placed.join(tails, PLACE, "left")
    header = F.when(F.col("opens"), F.concat("first", F.when((F.col("begun") == 1) & F.col("goes_on"), F.coalesce("tail", F.lit(""))).otherwise(F.lit(""))))
    header = F.first(header, True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return stored(placed.select(*PLACE, "size", "delimiter", "begun", "skip", "before", "tail", "opens", "cut", header.alias("header")))


def _at_places(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """Chunks that have a place, with it. Texts stay where they are as long as the places are few."""
    few = places.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS
    return chunks.join(F.broadcast(places) if few else places, PLACE)


@lru_cache(maxsize=64)
def header_cells(header: str, delimiter: str) -> tuple[str, ...]:
    return tuple(next(csv.reader(lines_of(header), delimiter=delimiter), []))


def _rows(text: str, delimiter: str, opens: bool) -> Iterator[list[str]]:
    """The records of a chunk's text; blank lines are none, but for the one that opens a file."""
    csv.field_size_limit((1 << 31) - 1)
    for k, row in enumerate(csv.reader(lines_of(text), delimiter=delimiter)):
        if row or opens and k == 0:
            yield row


def _payload(header: Sequence[str], row: list[str]) -> str:
    """A record as JSON. A repeated name keeps its last cell, missing cells are null, surplus ones go under ``null``."""
    cells: dict = dict(zip(header, row))
    if len(row) > len(header):
        cells[None] = row[len(header) :]
    cells.update((name, None) for name in header[len(row) :])
    return json.dumps(cells, ensure_ascii=False, separators=(",", ":"))


def _parsed(chunks: DataFrame, places: DataFrame, made: Callable[[Sequence[str], list[str]], object], kind: str, arrow: pa.DataType) -> DataFrame:
    """(path, record, made): one row for each record after the header, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row is a chunk: one at a time
                path, text, delimiter, skip, before, tail, opens, cut, header = (c[k].as_py() for c in batch.columns)
                text = (text[skip:-1] if cut and skip < len(text) else text[skip:]) + (tail or "")
                names = header_cells(header, delimiter)
                rows = [made(names, row) for n, row in enumerate(_rows(text, delimiter, opens)) if n or not opens]
                first = before + opens
                numbers = pa.array(np.arange(first, first + len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), numbers, pa.array(rows, arrow)], names=["path", "record", "made"])

    joined = _at_places(chunks.select(*PLACE, "text"), places)
    return joined.select("path", "text", "delimiter", "skip", "before", "tail", "opens", "cut", "header").mapInArrow(run, f"path string, record long, made {kind}")


def payloads(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(path, record, made): every record as JSON text."""
    return _parsed(chunks, places, _payload, "string", pa.string())


@lru_cache(maxsize=64)
def _columns_at(header: tuple[str, ...], columns: tuple[str, ...]) -> list[int]:
    lacking = [c for c in columns if c not in header]
    if lacking:
        raise ValueError(f"no column {lacking} in {list(header)}")
    return [header.index(c) for c in columns]


def cells(chunks: DataFrame, places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every record by the names in its file's header. Missing cells are null, surplus ones are left out; a column that a
    header lacks is an error."""
    columns = tuple(columns)

    def pick(header: tuple[str, ...], row: list[str]) -> list[str | None]:
        return [row[k] if k < len(row) else None for k in _columns_at(header, columns)]

    found = _parsed(chunks, places, pick, "array<string>", pa.list_(pa.string()))
    return found.select(*[F.get("made", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def file_counts(places: DataFrame) -> DataFrame:
    """(path, size, n): records of every file without its header, as the automaton counts them."""
    return places.groupBy("path", "size").agg((F.sum("begun") - 1).alias("n"))
