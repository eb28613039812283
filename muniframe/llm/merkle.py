"""A Merkle manifest of a table and the inclusion proof of each of its rows.

A row is a leaf: the digest of its columns. Leaves of one group, in key order, make a tree of runs of three; the roots of
the groups, in group order, make another one, whose root stands for the whole table.

*Numbering.* One range sort by (group, key) numbers the leaves; what passes between its partitions is a count per partition and group, so a
group of any size is spread over many tasks.

*Building.* A task hashes BLOCK successive leaves of a tree up to one node, six levels higher. The nodes of all
trees then go through the same step, a 729th of the rows each time. The nodes from the sixth level on make the node table;
lower ones are cheaper to hash anew than to store.

*Proving.* Octopus multiproofs: a leaf partition (some PART leaves, whole blocks) works out which nodes its leaves miss
together, level by level: of each parent of what it has or can derive, the children it neither has nor derives. This
needs coordinates only, no digests. Each of them is fetched once by one join with the node table. The partition then derives the nodes
that its leaves share and writes out the proof of each leaf from them.

Only digests and coordinates are shuffled. Nodes near the root are wanted by many partitions; they are the hot keys
of that join, of which each partition asks once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordering import PART as SORT_PART, POS, number_rows, range_sorted, running_sum
from .tables import stored

FAN, RISE = 3, 6
#: Leaves that one task step hashes to one node, and leaves of a leaf partition (less than a block more).
BLOCK, PART = FAN**RISE, FAN**8
#: The tree over the roots of the groups.
TOP = -1

NODES = "tree long, level int, idx long, size long, hash string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of the values, each as its length in bytes, ``:`` and its text, or ``-`` where it is null."""
    texts = [c.cast("string") for c in columns]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: own (the columns handed in), leaf, tree, idx, size (of the tree), trees, part. ``nodes``: the node table."""

    leaves: DataFrame
    nodes: DataFrame


def _placed(leaves: DataFrame) -> DataFrame:
    """Every leaf's tree, place in it, size of its tree, number of trees, and partition. Equal leaves change places freely."""
    keyed = range_sorted(leaves, ["group"], ["key", "leaf", "salt"])
    segments = keyed.groupBy(SORT_PART, "group").agg(F.min(POS).alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("group").orderBy(SORT_PART).rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    groups = number_rows(segments.groupBy("group").agg(F.sum("rows").alias("size")), ["group"], "tree", size="trees")
    groups = running_sum(groups, ["tree"], "size", "upto").withColumnRenamed("group", "its_group")
    segments = segments.join(groups, F.col("group").eqNullSafe(F.col("its_group"))).drop("group").withColumnRenamed(SORT_PART, "its_part")
    joined = keyed.join(segments, (F.col(SORT_PART) == F.col("its_part")) & F.col("group").eqNullSafe(F.col("its_group")))
    idx = F.col(POS) - F.col("first") + F.col("before")
    block_start = F.col("upto") - F.col("size") + idx - idx % BLOCK
    placed = {"tree": (F.col("tree") - 1).cast("long"), "idx": idx.cast("long"), "part": F.floor(block_start / PART).cast("long")}
    return joined.withColumns(placed).select("own", "leaf", "tree", "idx", "size", "trees", "part")


def _risen(nodes: DataFrame, whole: bool) -> DataFrame:
    """The nodes above a level, up to RISE levels or the root of their tree; with ``whole`` all of them, else the highest."""

    def climb(table: pa.Table) -> pa.Table:
        tree, level, size = (table[c][0].as_py() for c in ("tree", "level", "size"))
        held = sorted(zip(table["idx"].to_pylist(), table["hash"].to_pylist()))
        first, row = held[0][0], [h for _, h in held]
        out = [] if size > 1 else [(tree, level, first, size, row[0])]
        for step in range(RISE):
            if size == 1:
                break
            row = [digest("".join(row[k : k + FAN])) for k in range(0, len(row), FAN)]
            first, size, level = first // FAN, -(-size // FAN), level + 1
            if whole or size == 1 or step == RISE - 1:
                out += [(tree, level, first + k, size, h) for k, h in enumerate(row)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["tree", "level", "idx", "size", "hash"])

    return nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block")).applyInArrow(climb, NODES)


def _grown(found: list[DataFrame], widest: int) -> list[DataFrame]:
    """Levels above the nodes last found, until the tree of ``widest`` nodes on that level has its root."""
    while widest > 1:
        level = found[-1].agg(F.max("level")).first()[0]
        found.append(stored(_risen(found[-1].where((F.col("level") == level) & (F.col("size") > 1)), whole=True)))
        widest = -(-widest // BLOCK)
    return found


def build(leaves: DataFrame, key: str = "doc_id", group: str = "source") -> Manifest:
    """The manifest of ``leaves`` (key, group, leaf and any other columns, whatever their names).

    Leaves of one group go by key (null first), then digest; groups by their text, null first. Repeated rows are leaves each. An empty table has no nodes."""
    fixed = leaves.select(F.struct("*").alias("own"), F.col(key).alias("key"), F.col(group).alias("group"), "leaf", F.rand(1).alias("salt"))
    placed = stored(_placed(stored(fixed)))
    widest, trees = placed.agg(F.max("size"), F.max("trees")).first()
    if widest is None:
        return Manifest(placed, leaves.sparkSession.createDataFrame([], NODES))
    base = stored(_risen(placed.select("tree", F.lit(0).alias("level"), "idx", "size", F.col("leaf").alias("hash")), whole=False))
    found = _grown([base], -(-widest // BLOCK))
    own = found[0]
    for more in found[1:]:
        own = own.unionByName(more)
    roots = own.where(F.col("size") == 1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "hash")
    top = stored(roots)
    for more in _grown([top], trees):
        own = own.unionByName(more)
    return Manifest(placed, own)


# ---- octopus ------------------------------------------------------------------------------------


def missing(known: set[int], level: int, size: int) -> Iterator[tuple[int, int]]:
    """(level, idx) of the nodes that ``known`` ones of a level need to reach the root of their tree, each once."""
    while size > 1:
        above = {k // FAN for k in known}
        for parent in sorted(above):
            yield from ((level, k) for k in range(FAN * parent, min(FAN * parent + FAN, size)) if k not in known)
        known, level, size = above, level + 1, -(-size // FAN)


def risen(size: int, levels: int) -> tuple[int, int]:
    """Level and size of a tree's level at most ``levels`` above its leaves."""
    level = 0
    while level < levels and size > 1:
        level, size = level + 1, -(-size // FAN)
    return level, size


def _wanted(blocks: DataFrame) -> DataFrame:
    """(part, tree, level, idx): the coordinates each partition lacks, and that of the root to compare with."""

    def run(table: pa.Table) -> pa.Table:
        part, trees = table["part"][0].as_py(), table["trees"][0].as_py()
        held: dict[int, tuple[int, set[int]]] = {}
        for tree, size, block in zip(*(table[c].to_pylist() for c in ("tree", "size", "block"))):
            held.setdefault(tree, (size, set()))[1].add(block)
        want = []
        for tree, (size, own) in held.items():
            level, there = risen(size, RISE)
            want += [(part, tree, *at) for at in missing(own, level, there)]
        want += [(part, TOP, *at) for at in missing(set(held), 0, trees)]
        want.append((part, TOP, risen(trees, 99)[0], 0))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*want), kinds)], names=["part", "tree", "level", "idx"])

    return blocks.groupBy("part").applyInArrow(run, "part long, tree long, level int, idx long")


class Multiproof:
    """What a leaf partition knows of one tree: the nodes it has, was given and derives. ``rest`` of a leaf is the text of its siblings from its
    level up, and ``folded`` climbs with another leaf in its place."""

    def __init__(self, known: dict[int, str], size: int, given: dict[tuple[int, int], str]):
        self.runs: list[dict[int, tuple[str, ...]]] = []
        level = 0
        while size > 1:
            runs = {}
            for parent in {k // FAN for k in known}:
                children = range(FAN * parent, min(FAN * parent + FAN, size))
                runs[parent] = tuple(known[k] if k in known else given[level, k] for k in children)
            self.runs.append(runs)
            known = {parent: digest("".join(run)) for parent, run in runs.items()}
            size, level = -(-size // FAN), level + 1
        self.root = known[0]
        self._rest: list[dict[int, str]] = [{} for _ in self.runs]

    def rest(self, idx: int, level: int = 0) -> str:
        """The siblings of a node and of all nodes above it, level by level, left to right; shared parts are made once."""
        if level == len(self.runs):
            return ""
        known = self._rest[level].get(idx)
        if known is None:
            run, at = self.runs[level][idx // FAN], idx % FAN
            known = "".join(run[:at] + run[at + 1 :]) + self.rest(idx // FAN, level + 1)
            if level:
                self._rest[level][idx] = known
        return known

    def folded(self, idx: int, own: str) -> str:
        """The root that follows from ``own`` at a leaf and the siblings on its way."""
        for runs in self.runs:
            run, at = runs[idx // FAN], idx % FAN
            own, idx = digest("".join(run[:at]) + own + "".join(run[at + 1 :])), idx // FAN
        return own


PROVED = "subroot string, root string, proof string, folded_root string"


def prove(manifest: Manifest, columns: Sequence[str], claim: str = "leaf") -> DataFrame:
    """``columns`` of the leaves, subroot, root, proof (the siblings' digests from the leaf to the root), folded_root (what the digest in
    column ``claim`` and the proof give) and verified (folded_root is the manifest's root), one row per leaf.

    A null claim is verified as false, with a null folded_root."""
    leaves = manifest.leaves
    blocks = leaves.groupBy("part", "tree", "size", "trees", F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.lit(1).alias("one"))
    fetched = _wanted(blocks).join(manifest.nodes.select("tree", "level", "idx", "hash"), ["tree", "level", "idx"])
    kept = leaves.select("part", "tree", "idx", "size", "trees", "leaf", F.col(f"own.{claim}").alias("claim"), F.struct(*[F.col(f"own.{c}") for c in columns]).alias("own"))
    schema = f"own {kept.schema['own'].dataType.simpleString()}, {PROVED}"

    def run(table: pa.Table, nodes: pa.Table) -> pa.Table:
        given: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, idx, value in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "idx", "hash"))):
            given.setdefault(tree, {})[level, idx] = value
        tree, idx, size, leaf, claim = (table[c].to_pylist() for c in ("tree", "idx", "size", "leaf", "claim"))
        trees = table["trees"][0].as_py()
        known: dict[int, dict[int, str]] = {}
        sizes = dict(zip(tree, size))
        for t, k, h in zip(tree, idx, leaf):
            known.setdefault(t, {})[k] = h
        each = {t: Multiproof(known[t], sizes[t], given.get(t, {})) for t in known}
        top = Multiproof({t: p.root for t, p in each.items()}, trees, given[TOP])
        root = given[TOP][risen(trees, 99)[0], 0]
        out = []
        for t, k, c in zip(tree, idx, claim):
            own = None if c is None else top.folded(t, each[t].folded(k, c))
            out.append((each[t].root, root, each[t].rest(k) + top.rest(t), own))
        return pa.Table.from_arrays([table["own"].combine_chunks(), *(pa.array(list(c), pa.string()) for c in zip(*out))], names=["own", "subroot", "root", "proof", "folded_root"])

    proved = kept.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(run, schema)
    return proved.select("own.*", "subroot", "root", "proof", "folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified"))
