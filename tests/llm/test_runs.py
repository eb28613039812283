"""Runs of repeated words against plain Python: stretches by every period, on the small table, random and odd texts."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import runs
from muniframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """(start, period, length): for every period the stretches of words equal to the one a period on; the least period of a stretch counts."""
    found = {}
    for period in range(1, len(words) // times + 1):
        begin = None
        for i in range(len(words) - period + 1):
            if i < len(words) - period and words[i] == words[i + period]:
                begin = i if begin is None else begin
            elif begin is not None:
                if i + period - begin >= max(least, times * period):
                    found.setdefault((begin, i + period), period)
                begin = None
    return sorted((s, p, e - s) for (s, e), p in found.items())


def looped(doc_id, text):
    words, h = brute.BLANK_WORDS.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(doc_id, words):
    found = plain_runs(words)
    gone = {i for s, p, n in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    facts = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, p, n in found)
    return (doc_id, len(found), *facts, brute.sha(listed), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("directory", [SF, "/root/testdata/sf0.01"])
def test_query(spark, directory):
    docs = brute.table("documents", directory)[:300]
    wanted = {d["doc_id"] for d in docs}
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, directory).collect() if r.doc_id in wanted)
    assert got == sorted(digest(d["doc_id"], looped(d["doc_id"], d["text"])) for d in docs)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_random_words(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // rng.randint(2, 8)))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        first = np.cumsum([0, *map(len, texts)])
        got = [tuple(r) for r in runs.runs_of(np.array(sum(texts, []), np.int64), first, least, times).tolist()]
        assert got == sorted((int(f) + s, int(f) + s + n, p) for f, t in zip(first, texts) for s, p, n in plain_runs(t, least, times))


def test_places_in_blocks(monkeypatch):
    monkeypatch.setattr(runs.Places, "BLOCK", 4)
    test_random_words(6, 4)


ODD = [None, "", " \n\t", "one", "x " * 7, "x x x x x", "a b " * 4, "a b " * 4 + "a", "é 漢\x0b" * 40, "a\x00b " * 9, " ".join(["word"] * 60_000), "p q r " * 30 + "s " * 30]


def test_odd_rows(spark):
    rows = [(i, t, "clash", 1, None) for i, t in enumerate(ODD)] + [(3, "x " * 7, None, 2, None), (3, "x " * 7, None, 2, None), (None, "y " * 8, None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long, collapsed string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        words = brute.BLANK_WORDS.findall(text or "")
        found = plain_runs(words) if len(words) < 1000 else [(0, 1, len(words))]
        gone = {i for s, p, n in found for i in range(s + p, s + n)}
        want.append((key, len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want, key=str)
    assert runs.find_runs(docs.limit(0)).count() == 0
    named = docs.selectExpr("cast(doc_id as string) as name", "text as body")
    assert runs.find_runs(named, "name", "body", 8, 2).columns == ["name", "n_words", "runs", "collapsed"]
