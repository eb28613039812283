"""Near-duplicate groups by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum over the text's shingles, so a
signature of 2k values takes k hash evaluations per shingle. Bands of the signature nominate pairs; a pair
becomes a link only when the full shingle sets confirm it.

Texts with equal shingle sets are one node from the start. Within a bucket no list of all pairs is made:
each member is first compared with the bucket's leader, the member that shares buckets with the most others
(in a group of edited copies that is the original). Members that are then still in another component than
their leader, the strays, meet all members of the leader's component that share such a bucket, in blocks that hold
their full sets; one confirmed link per stray and component comes out. Pairs are thinned by the agreement
of their sketches, half a byte of each signature value; the margin is over five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import checkpointed
from .batches import BLANKS, Words, chunks, hashed, lowered, mask_of, mixed
from .tables import opened, packed_texts, stored

PERMUTATIONS = 256
VALUES = 2 * PERMUTATIONS
#: The bands use the first BANDS x ROWS signature values; sketches use all.
BANDS, ROWS = 32, 5
THRESHOLD = 80  # percent
#: Share of equal half bytes in sketches of sets at the threshold (unequal values agree by chance once in 16) less 5.2 deviations.
_EXPECTED = 0.8 + 0.2 / 16
AGREEMENT = _EXPECTED - 5.2 * (_EXPECTED * (1 - _EXPECTED) / VALUES) ** 0.5
#: Documents on either side of a block in which strays are compared; their sets are in memory together.
BLOCK = 4000
#: Words in a shingle where the caller gives none.
SIZE = 2

INSIDE = ~mask_of(BLANKS)
_RANDOM = np.random.default_rng(20).integers(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint32)
FACTORS, SHIFTS = _RANDOM[0] | np.uint32(1), _RANDOM[1]


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat, with their bounds. Fewer words than ``size``: the whole sequence is one shingle."""
    data = lowered(data)
    words = Words(data, at, INSIDE[data])
    texts = len(at) - 1
    h = hashed(words.distinct)[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    counts = words.per_text
    run = h.copy()
    for k in range(1, size):
        run[:-k or None] = run[:-k or None] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    run = mixed(run)
    sets = []
    for t in range(texts):
        a, b = words.first[t], words.first[t + 1]
        if counts[t] >= size:
            sets.append(np.unique(run[a : b - size + 1]))
        elif counts[t]:
            whole = np.uint64(counts[t])
            for x in h[a:b]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mixed(np.array([whole]) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            sets.append(h[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else h[:0]), bounds


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, VALUES): minimum and maximum of every permutation, side by side. Sets must not be empty."""
    out = np.empty((len(bounds) - 1, VALUES), np.uint32)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1]
    for k in range(PERMUTATIONS if len(starts) else 0):
        h = x * FACTORS[k] + SHIFTS[k]
        out[:, 2 * k] = np.minimum.reduceat(h, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; the band's number is part of the key."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * ROWS + k])
        keys[:, b] = h
    return keys


SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Set size, a 128-bit key of the set, band keys and the sketch, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, text):
            flat, bounds = shingle_sets(data, at, size)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands = np.zeros((n, BANDS), np.uint64)
            brief = np.zeros((n, PERMUTATIONS), np.uint8)
            if len(full):
                starts = bounds[:-1][full]
                signature = signatures(flat, np.append(starts, len(flat)))
                k1[full] = np.add.reduceat(mixed(flat), starts)
                k2[full] = np.add.reduceat(mixed(flat ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                bands[full] = band_keys(signature)
                half = ((signature * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
                brief[full] = half[:, ::2] << 4 | half[:, 1::2]
            values = pa.array(bands.view(np.int64).ravel())
            made = [
                rows.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), values),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(PERMUTATIONS), n, [None, pa.py_buffer(brief.tobytes())]).cast(pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, SKETCH)


def sets_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids`` (one column, distinct). Texts are compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(opened(batches)):
            flat, bounds = shingle_sets(data, at, size)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["doc_id", "shingles"])

    own = packed_texts(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")))
    needed = own.join(ids.withColumnRenamed("doc_id", "doc"), "doc", "left_semi")
    return needed.mapInArrow(run, "doc_id long, shingles array<long>")


def _halves(sketches: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, PERMUTATIONS)
    return np.concatenate([both >> 4, both & 15], axis=1)


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sketches agree often enough to be worth a comparison."""
    brief = nodes.select("node", "sketch", "n_shingles")
    sides = pairs.join(brief.toDF("a", "sketch_a", "n_a"), "a").join(brief.toDF("b", "sketch_b", "n_b"), "b")
    sides = sides.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(THRESHOLD) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_halves(batch.column(k).to_pylist()) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= AGREEMENT))

    return sides.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


BLOCK_KEYS = ["home", "i", "j"]


def in_blocks(near: DataFrame, block: int | None = None) -> DataFrame:
    """``near``: (home, node, c, stray), distinct: the nodes around a component. Every stray meets every node of its home in one
    block (home, i, j): nodes are dealt to rows i and copied along j, strays to columns j and copied along i."""
    block = block or BLOCK
    sizes = near.groupBy("home").agg(F.count(F.lit(1)).alias("all"), F.count_if("stray").alias("strays")).where("strays > 0")
    wide = sizes.select("home", F.ceil(F.col("all") / block).cast("int").alias("rows"), F.ceil(F.col("strays") / block).cast("int").alias("columns"))
    i, j = F.pmod(F.hash("node"), F.col("rows")), F.pmod(F.hash("node", F.lit(1)), F.col("columns"))
    right = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(False).alias("asks")))
    left = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    cells = F.when(F.col("stray"), F.concat(right, left)).otherwise(right)
    return near.join(wide, "home").select("home", "node", "c", F.explode(cells).alias("cell")).select("home", "cell.i", "cell.j", "cell.asks", "node", "c")


def block_links(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Confirmed links between the asking rows of a block and rows of other components: one per asking row and component."""
    node, c, asks = (np.asarray(rows[k]) for k in ("node", "c", "asks"))
    sketch = _halves(rows["sketch"].to_pylist())
    lists = rows["shingles"].combine_chunks()
    flat, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    size = np.diff(bounds)
    others = np.flatnonzero(~asks)
    a, b = [], []
    for k in np.flatnonzero(asks):
        fit = others[(c[others] != c[k]) & (100 * np.minimum(size[others], size[k]) >= THRESHOLD * np.maximum(size[others], size[k]))]
        share = np.concatenate([(sketch[part] == sketch[k]).mean(axis=1) for part in np.array_split(fit, max(1, len(fit) // 4096))])
        fit, share = fit[share >= AGREEMENT], share[share >= AGREEMENT]
        fit = fit[np.argsort(-share, kind="stable")]
        mine, reached = np.sort(flat[bounds[k] : bounds[k + 1]]), set()
        for part in np.array_split(fit, max(1, len(fit) // 64)):
            part = part[[x not in reached for x in c[part].tolist()]] if reached else part
            if not len(part):
                continue
            ends = np.cumsum(size[part])
            theirs = flat[np.repeat(bounds[part] - (ends - size[part]), size[part]) + np.arange(int(ends[-1]))]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat(mine[at] == theirs, ends - size[part], dtype=np.int64)
            for m in part[100 * both >= THRESHOLD * (size[part] + size[k] - both)].tolist():
                if c[m] not in reached:
                    reached.add(int(c[m]))
                    a.append(int(node[k]))
                    b.append(int(node[m]))
    return a, b


def across(placed: DataFrame) -> DataFrame:
    """(a, b): confirmed links of ``in_blocks`` rows with their sketch and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            a, b = block_links(pa.concat_tables(held))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.Table] = []
        current = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            while table.num_rows:
                keys = np.stack([np.asarray(table[k]).astype(np.int64) for k in BLOCK_KEYS], axis=1)
                if held and current != tuple(keys[0]):
                    yield links()
                    held = []
                current = tuple(keys[0])
                same = (keys == keys[0]).all(axis=1)
                cut = len(same) if same.all() else int(same.argmin())
                held.append(table.slice(0, cut))
                table = table.slice(cut)
        if held:
            yield links()

    return placed.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "node").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose full sets meet the threshold."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(F.lit(100) * shared >= F.lit(THRESHOLD) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable, for every node of an edge. Least-neighbour rounds with pointer jumping."""
    both = checkpointed(edges.union(edges.select("b", "a").toDF("a", "b")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.toDF("b", "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = checkpointed(nearer.join(jump, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component")))
        moved = after.where(F.col("old") != F.col("component")).limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per input row; shingles are ``size`` words.

    Null and empty texts have no shingles, are linked with nothing and kept. Repeated rows are
    equal sets. A null doc_id stays alone: component null, kept. Extra columns are ignored."""
    table = stored(sketches(docs, key, text, size))
    full = table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"))
    first = full.join(classes.select(F.col("node").alias("doc_id"), "k1", "k2", "n_shingles"), ["doc_id", "k1", "k2", "n_shingles"])
    nodes = stored(first.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"))

    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    busy = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(busy, "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    top = F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("top")
    leaders = stored(members.join(central, "node").groupBy("bucket").agg(top).select("bucket", (-F.col("top.node")).alias("b")))
    stars = members.join(leaders, "bucket").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    sets = stored(sets_of(docs, members.select(F.col("node").alias("doc_id")).distinct(), key, text, size).dropDuplicates(["doc_id"]))
    links = stored(confirmed(stored(alike(stars, nodes)), sets))
    found = components(links)

    its = found.toDF("b", "home")
    led = leaders.join(its, "b", "left").select("bucket", F.coalesce("home", "b").alias("home"))
    placed = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    rest = stored(placed.join(led, "bucket").withColumn("stray", F.col("c") != F.col("home")))
    torn = rest.where("stray").select("bucket").distinct()
    near = stored(rest.join(torn, "bucket", "left_semi").select("home", "node", "c", "stray").distinct())
    blocks = in_blocks(near).join(nodes.select("node", "sketch"), "node").join(sets.withColumnRenamed("doc_id", "node"), "node")
    found = components(links.union(across(blocks)))

    of_class = classes.join(found, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "node").alias("component"))
    keys = ["k1", "k2", "n_shingles"]
    rows = table.select("doc_id", *keys)
    joined = rows.join(of_class, keys, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that are their group's least doc_id, all columns unchanged; rows that repeat that id stay with it."""
    drop = near_groups(docs, key, text, size).where(~F.col("kept")).select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, F.col(key) == F.col("_drop"), "left_anti")
