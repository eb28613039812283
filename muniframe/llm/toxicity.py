"""Toxicity of documents by multiple-instance learning.

Labels belong to documents, offences to sentences. A sentence's score is a logistic function of the weights of its
words; a document is toxic unless every sentence is harmless: p = 1 - prod(1 - p_sentence) (noisy-or). Training goes
through that formula, so the sentence scores are learned from document labels alone, and they tell where the offence is.

A word's weight is the sum over hashed features: the word without its punctuation, and its 4- and 5-byte stretches
with a mark at its start. Only features that toxic documents have clearly more often than chance (EVIDENCE standard
deviations) get a weight. It is worked out once per distinct word of a chunk. Training uses a bounded sample of
labelled documents (SAMPLE per label, the least hashes of doc_id), their whole texts; scoring covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .batches import BLANKS, Words, chunks, lowered, mask_of, mixed, text_bytes

INSIDE = ~mask_of(BLANKS)
STOPS = mask_of(b".!?")
SIGNS = mask_of(bytes(c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123)))
BITS = 18
#: Labelled documents of each label that are used to train, at most.
SAMPLE = {1: 3000, 0: 5000}
EPOCHS, RATE, DECAY = 80, 0.08, 1e-4
#: A feature counts from so many occurrences in toxic documents, and so many deviations above their share.
LEAST, EVIDENCE = 4, 4.0


def features(distinct: pa.BinaryArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of every feature of the words."""
    data, at = text_bytes(distinct)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    data = lowered(data)
    plain = ~SIGNS[data]
    data, owner = data[plain], owner[plain]
    sizes = np.bincount(owner, minlength=len(at) - 1)
    full = np.flatnonzero(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    # one mark before each word
    total = len(data) + len(full)
    marked = np.full(total, 0x5E, np.uint64)
    rank = np.cumsum(sizes > 0)
    marked[np.arange(len(data)) + rank[owner]] = data
    word = np.repeat(full, sizes[full] + 1)
    place = np.arange(total) - np.repeat(begin[full] + np.arange(len(full)), sizes[full] + 1)
    length = (sizes + 1)[word] if total else word
    words, slots = [], []
    whole = np.zeros(total, np.uint64)
    if total:
        power = mixed(place.astype(np.uint64) + np.uint64(77))
        first = np.flatnonzero(place == 0)
        whole = np.add.reduceat(mixed(marked * np.uint64(0x100000001B3) + power), first)
        words.append(full)
        slots.append(mixed(whole))
    for n in (4, 5):
        fits = np.flatnonzero(place + n <= length)
        h = np.full(len(fits), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + marked[fits + k] + np.uint64(1)
        words.append(word[fits])
        slots.append(mixed(h))
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(words), (np.concatenate(slots) & np.uint64((1 << bits) - 1)).astype(np.int64)


def sentences(data: np.ndarray, words: Words) -> np.ndarray:
    """First word of each sentence: after a word that ends in . ! or ?, after a line feed, and at the start of a text."""
    n = len(words.starts)
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[words.first[:-1][words.per_text > 0]] = True
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    new[1:] |= STOPS[data[words.ends[:-1] - 1]] | (lines[words.starts[1:]] > lines[words.ends[:-1]])
    return np.flatnonzero(new)


def telling(words: Words, owner: np.ndarray, slot: np.ndarray, toxic: np.ndarray, bits: int) -> np.ndarray:
    """Flags of the features whose words toxic documents have more often than their share of all documents explains."""
    kinds = len(words.distinct)
    pairs = np.unique(words.text_of() * kinds + words.codes)
    word = pairs % max(1, kinds)
    seen = np.bincount(slot, weights=np.bincount(word, minlength=kinds)[owner], minlength=1 << bits)
    in_toxic = np.bincount(slot, weights=np.bincount(word[toxic[pairs // max(1, kinds)]], minlength=kinds)[owner], minlength=1 << bits)
    share = toxic.mean()
    lead = (in_toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return ((in_toxic >= LEAST) & (lead >= EVIDENCE))[slot]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def train(texts: pa.Array, labels: np.ndarray, weight: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights of all slots, and the offset last: Adam on the noisy-or log-likelihood of whole documents."""
    data, at = text_bytes(texts)
    words = Words(data, at, INSIDE[data])
    first = sentences(data, words)
    count = len(first)
    in_sentence = np.repeat(np.arange(count), np.diff(np.append(first, len(words.codes))))
    of_text = words.text_of()[first] if count else first
    owner, slot = features(words.distinct, bits)
    theta = np.zeros((1 << bits) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    texts_n, kinds = len(at) - 1, len(words.distinct)
    toxic = labels == 1
    told = telling(words, owner, slot, toxic, bits)
    owner, slot = owner[told], slot[told]
    weight = weight / weight.sum()
    for epoch in range(1, EPOCHS + 1):
        by_word = np.bincount(owner, weights=theta[slot], minlength=kinds)
        z = np.clip(np.bincount(in_sentence, weights=by_word[words.codes], minlength=count) + theta[-1], -30, 30)
        harmless = np.bincount(of_text, weights=softplus(z), minlength=texts_n)  # -log(1 - p)
        pull = np.where(toxic, -np.exp(-harmless) / np.maximum(-np.expm1(-harmless), 1e-9), 1.0) * weight
        dz = pull[of_text] / (1 + np.exp(-z))
        d_word = np.bincount(words.codes, weights=dz[in_sentence], minlength=kinds)
        grad = np.append(np.bincount(slot, weights=d_word[owner], minlength=1 << bits), dz.sum())
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return theta.astype(np.float32)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] = SAMPLE) -> Broadcast:
    """Train on a bounded sample of the labelled rows outside the held-out fifth, in one task, and share the weights (2**BITS numbers).
    Both labels keep their share of all labelled rows by weight. Without a labelled row of each kind all weights stay at rest."""
    known = labels.where(~held_out(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_y"))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picks = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in sample.items()]
    chosen = picks[0].unionByName(picks[1])
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")  # at most the sample's rows
    shares = {y: sizes.get(y, 0) / max(1, min(sizes.get(y, 0), n)) for y, n in sample.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("_id", pa.int64()), ("text", pa.string()), ("_y", pa.int32())]))
        y = np.asarray(table["_y"])
        theta = np.zeros((1 << BITS) + 1, np.float32)
        theta[-1] = -5.0
        if len(np.unique(y)) == 2:
            theta = train(table["text"].combine_chunks(), y, np.where(y == 1, shares[1], shares[0]))
        slot = np.flatnonzero(theta)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(theta[slot])], names=["slot", "weight"])

    ordered = rows.select(F.col("_id").cast("long"), "text", F.col("_y").cast("int")).repartition(1).sortWithinPartitions("_id", "text")
    learned = ordered.mapInArrow(run, "slot int, weight float").toArrow()
    theta = np.zeros((1 << BITS) + 1, np.float32)
    theta[-1] = -5.0
    theta[np.asarray(learned["slot"])] = np.asarray(learned["weight"])
    return docs.sparkSession.sparkContext.broadcast(theta)


SCORES = "doc_id long, score double, n_sentences long, n_offending long, worst_begin long, worst_end long"


def score(docs: DataFrame, model: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, n_offending (sentences at 0.5 or more) and the byte span of the worst sentence (-1, -1: none).
    Null texts and texts without words score 0. One row per input row, repeated ones included; a null id stays null. Of equally bad sentences the
    first is the worst. Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = model.value
        for rows, data, at in chunks(batches, text):
            n = rows.num_rows
            words = Words(data, at, INSIDE[data])
            first = sentences(data, words)
            p, offending, count = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            begin, end = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            if len(first):
                owner, slot = features(words.distinct)
                by_word = np.bincount(owner, weights=theta[slot], minlength=len(words.distinct))
                z = np.clip(np.add.reduceat(by_word[words.codes], first) + theta[-1], -30, 30)
                of_text = words.text_of()[first]
                p = -np.expm1(-np.bincount(of_text, weights=softplus(z), minlength=n))
                offending = np.bincount(of_text, weights=z >= 0, minlength=n).astype(np.int64)
                count = np.bincount(of_text, minlength=n)
                by = np.lexsort((-np.arange(len(z)), z, of_text))
                last = np.append(np.flatnonzero(np.diff(of_text[by])), len(by) - 1)
                worst = by[last]
                t = of_text[worst]
                begin[t] = words.starts[first[worst]] - at[t]
                end[t] = words.ends[np.append(first[1:], len(words.starts))[worst] - 1] - at[t]
            made = [rows.column(0), pa.array(p), pa.array(count), pa.array(offending), pa.array(begin), pa.array(end)]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in SCORES.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, SCORES)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and where the worst sentence lies, one row per input row. A null doc_id is never held out. Without a training row
    of each label every score is that of a model at rest, below one half for texts of usual length."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_begin", "worst_end")
