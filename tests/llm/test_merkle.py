"""The Merkle manifest against its SQL and plain Python, on the small tables, hot groups, repeated and odd rows."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import merkle
from muniframe.llm.queries import ORACLE_SQL, QUERIES
from oracle import connect, difference

SF = "/root/testdata/sf0.001"


def coded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([brute.sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i, own):
    proof = ""
    for level in levels[:-1]:
        run, at = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        own, proof = brute.sha("".join(run[:at]) + own + "".join(run[at + 1 :])), proof + "".join(run[:at] + run[at + 1 :])
        i //= 3
    return proof, own


def plain(rows):
    """rows: (key, group, leaf, claim) -> (key, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([r[2] for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (key, _, leaf, claim) in enumerate(groups[g]):
            own, up = way(trees[g], i, claim or ""), way(top, k, "")[0]
            folded = None if claim is None else way(top, k, own[1])[1]
            out.append((key, leaf, trees[g][-1][0], top[-1][0], own[0] + up, folded, folded == top[-1][0]))
    return out


def proved(spark, rows, extra=None):
    leaves = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claim string").withColumns(extra or {})
    out = merkle.prove(merkle.build(leaves), ["doc_id", "leaf"], "claim")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("directory", [SF, "/root/testdata/sf0.01"])
def test_query(spark, directory):
    got = QUERIES["op12_merkle_manifest"](spark, directory).cache()
    assert difference(got, connect(directory), ORACLE_SQL["op12_merkle_manifest"]) is None
    assert 0 < got.where("verified").count() < got.count() and got.select("root").distinct().count() == 1


@pytest.mark.parametrize("block,part", [(9, 27), (3, 3), (729, 6561)])
def test_trees(spark, monkeypatch, block, part):
    """A hot group, many groups of one row, a group without name: blocks and partitions of several sizes give the same proofs."""
    monkeypatch.setattr(merkle, "RISE", {3: 1, 9: 2, 729: 6}[block])
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "PART", part)
    sizes = {None: 5, "": 1, "hot": 300, "Z": 28, "é": 27, "a": 3, **{f"one{k}": 1 for k in range(40)}}
    rows, key = [], 0
    for group, n in sizes.items():
        for _ in range(n):
            key += 7
            leaf = brute.sha(f"{group}{key}")
            rows.append((key % 1009, group, leaf, None if key % 5 == 0 else leaf if key % 3 else brute.sha("other")))
    assert proved(spark, rows) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_small(spark, n):
    rows = [(k, "s", brute.sha(str(k)), brute.sha(str(k))) for k in range(n)]
    assert proved(spark, rows) == sorted(plain(rows), key=str)
    rows = [(k, f"s{k}", brute.sha(str(k)), brute.sha(str(k))) for k in range(n)]
    assert proved(spark, rows) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    """Null and repeated keys, equal rows, columns with clashing names, an empty table."""
    same = brute.sha("same")
    rows = [(1, "s", same, same)] * 40 + [(None, "s", brute.sha("n"), same), (1, "s", brute.sha("t"), None), (2, None, same, same)]
    clash = {c: F.lit("x") for c in ("hash", "level", "__n", "first", "rows", "block", "proof", "verified", "own", "key", "group", "tree", "idx", "size", "part", "salt")}
    want = sorted(plain(rows), key=str)
    assert proved(spark, rows, clash) == want
    assert proved(spark, []) == []


def test_leaf_digest(spark):
    rows = [(1, None, "é\n"), (None, "", None), (-3, "1:a", "x" * 100_000)]
    docs = spark.createDataFrame(rows, "a long, b string, c string")
    got = docs.select("a", merkle.leaf_digest([F.col(c) for c in "abc"]).alias("leaf")).collect()
    assert {r.a: r.leaf for r in got} == {r[0]: brute.sha(coded(*r)) for r in rows}


def test_missing_is_least():
    """Every node asked for is needed, and no node that leaves or other asked ones give is asked for."""
    assert set(merkle.missing({0, 1, 2}, 0, 27)) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert set(merkle.missing({0, 3, 26}, 0, 27)) == {(0, 1), (0, 2), (0, 4), (0, 5), (0, 24), (0, 25), (1, 2), (1, 6), (1, 7), (2, 1)}
    assert list(merkle.missing(set(range(5)), 0, 5)) == [] == list(merkle.missing({0}, 3, 1))
