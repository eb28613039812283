"""Each pipeline stage on what the one before it kept, held against plain Python."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline as cp
from muniframe.llm.tables import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
    return [k.toPandas() for k in kept]


def test_stages_keep_columns_and_rows(steps):
    docs, good, single, clean, redacted, tokens = steps
    for a, b in zip(steps[:4], steps[1:5]):
        assert list(b.columns) == list(docs.columns) and set(b.doc_id) <= set(a.doc_id) and not b.doc_id.duplicated().any()
    assert all(not brute.base_quality(t)[5] for t in good.text)
    quality = {r["doc_id"]: r["quality"] for r in brute.table("labels", SF)}
    sound = [k for k, t in zip(docs.doc_id, docs.text) if not brute.base_quality(t)[5]]
    kept = lambda label: [k in set(good.doc_id) for k in sound if quality.get(k) == label]
    assert sum(kept(1)) >= 0.98 * len(kept(1)) > 0 and sum(kept(0)) <= 0.2 * len(kept(0)) > 0
    assert set(single.doc_id) == {r[0] for r in brute.near_groups(list(zip(good.doc_id, good.text)), size=5) if r[3]}
    items = [(b["item_id"], b["text"]) for b in brute.table("benchmark", SF)]
    assert set(clean.doc_id) == {r[0] for r in brute.leaks(list(zip(single.doc_id, single.text)), items) if not r[5]}
    assert set(redacted.doc_id) == set(clean.doc_id) == set(tokens.doc_id)
    before = dict(zip(clean.doc_id, clean.text))
    changed = {k for k, t in zip(redacted.doc_id, redacted.text) if t != before[k]}
    assert changed and all("<" in t for k, t in zip(redacted.doc_id, redacted.text) if k in changed)
    assert dict(zip(tokens.doc_id, tokens.decoded_sha256)) == {k: brute.sha(t) for k, t in zip(redacted.doc_id, redacted.text)}


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "words " * 60, "en", "s", 0)] + [(k, " ".join(f"w{k}x{i}" for i in range(70)), "en", "s", 1) for k in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            part = stored(stage(spark, part, SF))
    docs = docs.where("doc_id >= 5")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 4
