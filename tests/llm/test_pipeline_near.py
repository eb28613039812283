"""The near-duplicate stage links by 5-word shingles; the stages after it on what it kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline as cp
from muniframe.llm.tables import stored

SF = "/root/testdata/sf0.01"


def test_stage_takes_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(d["doc_id"], d["text"]) for d in brute.table("documents", SF)]
    two = {r[0] for r in brute.near_groups(rows) if r[3]}
    want = {r[0] for r in brute.near_groups(rows, size=5) if r[3]}
    single = stored(cp.near_duplicates(spark, docs, SF)).toPandas()
    assert set(single.doc_id) == want and len(want) > len(two) and two < want
    assert list(single.columns) == docs.columns


def test_scattered_edits_are_no_near_duplicates(spark):
    # one word in twenty differs: a copy shares 0.82 of its 2-word shingles with the original, 0.6 of its 5-word ones
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(f"x{k}" if i % 20 == k else w for i, w in enumerate(base)), "en", "s", 1) for k in range(2)] + [(2, " ".join(base), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()} == {0, 1, 2}


def test_stages_after_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
    _, _, single, clean, redacted, tokens = (k.toPandas() for k in kept)
    items = [(b["item_id"], b["text"]) for b in brute.table("benchmark", SF)]
    assert set(clean.doc_id) == {r[0] for r in brute.leaks(list(zip(single.doc_id, single.text)), items) if not r[5]}
    assert set(redacted.doc_id) == set(clean.doc_id) == set(tokens.doc_id)
    before = dict(zip(clean.doc_id, clean.text))
    changed = {k for k, t in zip(redacted.doc_id, redacted.text) if t != before[k]}
    assert changed and all("<" in t for k, t in zip(redacted.doc_id, redacted.text) if k in changed)
    assert dict(zip(tokens.doc_id, tokens.decoded_sha256)) == {k: brute.sha(t) for k, t in zip(redacted.doc_id, redacted.text)}
