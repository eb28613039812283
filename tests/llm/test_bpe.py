import base64
import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from public_tokenizers import PATTERN, path

from muniframe.llm import bpe
from muniframe.llm.batches import text_bytes

FILE = path("byte_bpe_50k.tiktoken")
PARTS = ["'", "s", "t", "re", "ve", "m", "ll", "d", "S", " ", "  ", "\n", "\t", "1", "٣", "é", "漢", "!", "?", " ", "　", "𝒳", "😀", "²", "ⅷ", "\r\n", "a" * 60, "-" * 70, "it's", " 'll"]


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts):
    flat, bounds, _ = bpe.encode_texts(*text_bytes(pa.array(texts, pa.string())), bpe.ranks(FILE))
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_mixed_scripts_and_contractions(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "'", "x'", "a" * 3000, "ab " * 3000, "abcdefgh" * 700]
    assert ids_of(texts) == reference.encode_ordinary_batch(texts)


def test_every_codepoint(reference):
    points = [chr(c) for c in range(0, 0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 100_000):
        texts = [f"a{c}a1{c}1 {c} {c}{c}" for c in points[begin : begin + 100_000 : 7]]
        assert ids_of(texts) == reference.encode_ordinary_batch(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_round_trip(texts):
    r = bpe.ranks(FILE)
    for text, ids in zip(texts, ids_of(texts)):
        assert r.decode(__import__("numpy").array(ids, int)).tobytes() == text.encode()


def test_digests_nulls_repeats_and_extra_columns(spark, reference):
    rows = [(1, None, "x"), (2, "", "y"), (3, "it's  fine\n", "z"), (3, "it's  fine\n", "z"), (4, "word " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digests(docs, FILE).collect()))
    want = []
    for key, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [g[:4] for g in got] == sorted(want)
    assert bpe.digests(docs.limit(0), FILE).count() == 0
    encoded = bpe.encode(docs, FILE, out="n_tokens")
    assert encoded.columns == ["doc_id", "text", "n_tokens"]
    assert sorted(bytes(r.decoded) for r in bpe.decode(encoded, FILE, ids="n_tokens").collect()) == sorted((t or "").encode() for _, t, _ in rows)
