import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import suffix_dedup as sd
from muniframe.llm.queries import QUERIES
from pyspark.sql import functions as F


def flat(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\x00ÿ", max_size=60).map(lambda t: t.encode("latin-1")), min_size=1, max_size=6), st.sampled_from([8, 16]))
def test_array_marks_what_repeats(strings, span):
    data, at = flat(strings)
    got = sd.repeated(data, at, span)
    seen = {}
    for t, s in enumerate(strings):
        for i in range(len(s) - span + 1):
            seen.setdefault(s[i : i + span], []).append(at[t] + i)
    want = sorted(p for places in seen.values() if len(places) > 1 for p in places)
    assert np.flatnonzero(got).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=80).map(str.encode), min_size=1, max_size=5))
def test_stretches_cover_every_window_and_follow_content(strings):
    data, at = flat(strings)
    text, low, high, anchor, _ = sd.stretches(data, at, span=12, k=5)
    by_window = {}
    for t, a, b, h in zip(text, low, high, anchor):
        for w in range(a, b + 1):
            assert at[t] <= w and w + 12 <= at[t + 1]
            by_window.setdefault(bytes(data[w : w + 12]), set()).add(int(h))
    assert sum(max(0, len(s) - 11) for s in strings) == int((high - low + 1).sum())
    assert all(len(h) == 1 for h in by_window.values())


def shown(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in df.collect())


def test_small_table(spark):
    docs = brute.table("documents")
    want = brute.repeats([(d["doc_id"], d["text"]) for d in docs])
    got = QUERIES["op1_suffix_array_dedup"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.collect()) == want and any(w[2] for w in want)


def test_odd_rows_and_crowded_anchors(spark):
    rng = np.random.default_rng(3)
    part = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    line, passage = part(150), part(330)
    rows = [(0, None), (1, ""), (2, "a" * 1000), (3, "ab" * 99), (4, "ab" * 99), (5, "ü" * 150), (6, passage), (7, passage), (8, part(199)), (9, passage[:199])]
    rows += [(10 + k, part(120) + line + part(90)) for k in range(40)]
    rows += [(60 + k, part(60) + passage[k:] + part(60) + passage[: 330 - k]) for k in range(40)]
    rows += [(200 + k, passage * 3) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    want = brute.repeats(rows)
    assert shown(sd.without_repeats(docs)) == want
    assert shown(sd.without_repeats(docs, hot=3)) == want
    assert shown(sd.without_repeats(docs, hot=2000)) == want
    twice = brute.repeats(rows + rows)
    assert shown(sd.without_repeats(docs.union(docs))) == twice
    assert sd.without_repeats(docs.limit(0)).count() == 0


def test_shared_and_missing_ids(spark):
    """Rows with one id and different texts, rows without an id, whole rows twice."""
    base = "".join(chr(97 + k * k % 23 + k % 3) for k in range(600))
    rows = [(1, base), (2, base), (1, "short"), (None, base[:300]), (None, "other"), (7, "unlike " * 3), (7, "unlike " * 3), (1, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in sd.without_repeats(docs).collect()), key=str)
    plain = brute.repeats([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == sorted(((rows[k][0], *rest) for k, *rest in plain), key=str)


def test_long_texts(spark):
    """A text of many chunks: what repeats within it, across its parts and in another row."""
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 5 << 20, dtype=np.uint8)).decode()
    passage = long[(1 << 20) - 150 : (1 << 20) + 250]
    rows = [(1, long + "#" + passage), (2, "x" * 50 + passage), (3, long[:100])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = (1 << 20) - 150
    assert got[1] == (len(long) + 401, 800, 2, brute.sha(long[:at] + long[at + 400 :] + "#"))
    assert got[2] == (450, 400, 1, brute.sha("x" * 50)) and got[3][1] == 0
