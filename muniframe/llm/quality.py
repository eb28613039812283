"""Quality rules: plain counts of every text, and the perplexity of its words under an n-gram model.

The model is an interpolated modified Kneser-Ney model over the bytes of a text's words with one blank after each:
n-grams run across words and stay within a text. A text's probability is computed from the distinct n-grams of a chunk.
Spark counts the n-grams of all documents (each task merges its own counts
before the shuffle). All of them, however rare, make the model: sorted arrays of hashed keys and probabilities, built on
the driver and shared with the executors. They grow with the distinct n-grams of the corpus.

The verdict: the mean negative log-probability per byte and that per word must each lie in a band of the text's language
(marks after every word are cheap by the byte, marks between words are cheap by the word). A short text's mean varies more, so
its distance from the language's median is divided by sqrt(1 + 100 / words) first. Below and above the median
the band ends at ``width`` robust standard deviations of these distances, each side by its own quartile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stored
from .batches import BLANKS, Words, chunks, mask_of, mixed, slices, spans_of, text_bytes, total_per_text

ORDER = 5
WIDTH = 4.0
#: Words at which the variance of a text's mean is twice that of a long text, and a quartile in standard deviations.
ROOM, QUARTILE = 100.0, 0.6745
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 21
#: Text bytes looked at at once; the arrays beside them take some 60 times as much.
CHUNK = 2 << 20

INSIDE = ~mask_of(BLANKS)
SIGNS = mask_of(b"#*$%&|<>")


def keys_of(data: np.ndarray, inside: np.ndarray, words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text's words and the blank after each word: the last ``order`` bytes as one integer; and the
    bounds of the texts (n + 1)."""
    last = np.cumsum(words.ends - words.starts + 1) - 1
    bounds = np.concatenate([[0], last + 1])[words.first]
    byte = np.full(int(bounds[-1]), 0x20, np.int64)
    letter = np.ones(len(byte), bool)
    letter[last] = False
    byte[letter] = data[inside]
    starts, sizes = bounds[:-1], np.diff(bounds)
    key = byte.copy()
    for back in range(1, order):
        before = np.full(len(byte), 0x20, np.int64)
        before[back:] = byte[:-back]
        for k in range(back):
            before[starts[sizes > k] + k] = 0x20
        key |= before << (8 * back)
    return key, bounds


def coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and each key's number among them."""
    found = pa.array(key).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def count_ngrams(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, count) of all n-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, data, at in chunks(batches, text, CHUNK):
            inside = INSIDE[data]
            key, number = coded(keys_of(data, inside, Words(data, at, inside), order)[0])
            weight = np.bincount(number, minlength=len(key))
            merged, number = np.unique(np.concatenate([keys, key]), return_inverse=True)
            keys, counts = merged, np.bincount(number, weights=np.concatenate([counts, weight]), minlength=len(merged)).astype(np.int64)
            if len(keys) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "count"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "count"])

    parts = docs.select(text).mapInArrow(run, "key long, count long")
    return parts.groupBy("key").agg(F.sum("count").alias("count"))


class Model:
    """Sorted hash arrays: for each order the hashes of its n-grams with log-probabilities, and of its contexts with log back-off weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        tables = {order: (keys, counts.astype(np.float64))}
        for n in range(order - 1, 0, -1):  # shorter n-grams count the distinct bytes seen before them
            tables[n] = tuple(np.unique(tables[n + 1][0] & ((1 << (8 * n)) - 1), return_counts=True))
        lower_keys, lower = np.empty(0, np.int64), np.empty(0)
        self.ngrams, self.contexts = {}, {}
        for n in range(1, order + 1):
            key, count = tables[n]
            count = count.astype(np.float64)
            order_by = np.argsort(key)
            key, count = key[order_by], count[order_by]
            steps = self._discounts(count)
            step = steps[np.minimum(count, 3).astype(np.int64)]
            context, number = np.unique(key >> 8, return_inverse=True)
            total = np.bincount(number, weights=count)
            weight = np.bincount(number, weights=step) / np.maximum(total, 1)
            if n == 1:
                below = np.full(len(key), 1 / 257)
            else:
                below = lower[np.searchsorted(lower_keys, key & ((1 << (8 * (n - 1))) - 1))]
            p = (count - step) / np.maximum(total[number], 1) + weight[number] * below
            lower_keys, lower = key, p
            self.ngrams[n] = self._sorted(key, np.log(np.maximum(p, 1e-12)))
            self.contexts[n] = self._sorted(context, np.log(np.maximum(weight, 1e-12)))

    @staticmethod
    def _discounts(count: np.ndarray) -> np.ndarray:
        """Discount of counts 0, 1, 2 and 3 or more, from the counts of counts; plain halves where those don't suffice."""
        n1, n2, n3, n4 = (float((count == k).sum()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return np.array([0, 0.5, 0.5, 0.5])
        y = n1 / (n1 + 2 * n2)
        return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05] * 3, [0.95, 1.95, 2.95])])

    @staticmethod
    def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mixed(key.astype(np.uint64))
        by = np.argsort(hashes)
        return hashes[by], value[by].astype(np.float32)

    @staticmethod
    def _found(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, values = table
        if not len(hashes):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        h = mixed(key.astype(np.uint64))
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[k] == h, values[k]

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of each key's last byte after the bytes before it."""
        out = np.zeros(len(key))
        open_ = np.arange(len(key))
        for n in range(self.order, 0, -1):
            k = key[open_] & ((1 << (8 * n)) - 1)
            hit, value = self._found(self.ngrams[n], k)
            out[open_[hit]] += value[hit]
            open_, k = open_[~hit], k[~hit]
            hit, value = self._found(self.contexts[n], k >> 8)
            out[open_[hit]] += value[hit]
        out[open_] += np.log(1 / 257)
        return out


def fit(docs: DataFrame, text: str = "text", order: int = ORDER) -> Broadcast:
    """Count all n-grams and share the arrays with the executors."""
    table = count_ngrams(docs, text, order).toArrow()
    model = Model(np.asarray(table["key"]), np.asarray(table["count"]), order)
    return docs.sparkSession.sparkContext.broadcast(model)


MEASURES = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("log_perplexity", T.DoubleType()),
    T.StructField("word_log_perplexity", T.DoubleType()),
]


def measures(data: np.ndarray, at: np.ndarray, model: Model | None) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk, and the mean negative log-probability of its bytes and of its words (NaN without words)."""
    inside = INSIDE[data]
    words = Words(data, at, inside)
    texts = len(at) - 1
    n_words, text_of = words.per_text, words.text_of()
    out = {
        "n_words": n_words, "word_chars": total_per_text(inside & ((data & 0xC0) != 0x80), at), "n_symbols": total_per_text(SIGNS[data], at),
        "n_dup_lines": _repeated_lines(data, at, inside), "n_repeat_words": _repeated_words(words, text_of, texts),
    }
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    if model is not None:
        key, bounds = keys_of(data, inside, words, model.order)
        distinct, number = coded(key)
        surprise = total_per_text(-model.log_p(distinct)[number], bounds)
        out["log_perplexity"] = np.where(n_words > 0, surprise / np.maximum(np.diff(bounds), 1), np.nan)
        out["word_log_perplexity"] = np.where(n_words > 0, surprise / np.maximum(n_words, 1), np.nan)
    return out


def _repeated_lines(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    texts = len(at) - 1
    starts, ends = _lines(data, at)
    if not len(starts):
        return np.zeros(texts, np.int64)
    seen = np.concatenate([[0], np.cumsum(inside)])
    real = seen[ends] > seen[starts]
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return np.zeros(texts, np.int64)
    codes = slices(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.searchsorted(at, starts, side="right") - 1
    pairs = owner * (int(codes.max()) + 1) + codes
    distinct = np.unique(pairs) // (int(codes.max()) + 1)
    return np.bincount(owner, minlength=texts) - np.bincount(distinct, minlength=texts)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty stretches between line feeds and text bounds."""
    return spans_of(data != 0x0A, at)


def _repeated_words(words: Words, text_of: np.ndarray, texts: int) -> np.ndarray:
    """Words inside 3-word windows that their text has twice or more."""
    codes = words.codes
    if len(codes) < 3:
        return np.zeros(texts, np.int64)
    number = len(words.distinct)
    pair = codes[:-2] * number + codes[1:-1]
    if number < 1 << 21:
        key = pair * number + codes[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1] * number + codes[2:]
    whole = np.flatnonzero(text_of[:-2] == text_of[2:])
    key, owner = key[whole], text_of[whole]
    order = np.argsort(key, kind="stable")  # stable: equal windows of one text stay together
    same = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    places = whole[order[twice]]
    hit = np.zeros(len(codes), bool)
    for k in range(3):
        hit[places + k] = True
    return np.bincount(text_of[hit], minlength=texts)


def measured(docs: DataFrame, model: Broadcast, text: str = "text") -> DataFrame:
    """All columns plus MEASURES (equal names are replaced). Null and empty texts: zero counts, base_failed, perplexity null."""
    docs = docs.drop(*[f.name for f in MEASURES])
    schema = T.StructType([*docs.schema.fields, *MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, text, CHUNK):
            made = measures(data, at, model.value)
            arrays = [pa.array(made[f.name], from_pandas=True) for f in MEASURES]
            yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*rows.schema.names, *(f.name for f in MEASURES)])

    return docs.mapInArrow(run, schema)


#: The scores with the digits they are rounded to, so that exact percentiles need a bounded table, and the least deviation.
SCORES = {"log_perplexity": (3, 0.01), "word_log_perplexity": (2, 0.05)}


def room() -> Column:
    return F.sqrt(1 + F.lit(ROOM) / F.greatest("n_words", F.lit(1)))


#: Languages whose bands are sent to every executor; with more of them rows and bands meet in so many parts a language.
LANGUAGES, PARTS = 10_000, 64


def _by_language(rows: DataFrame, table: DataFrame, lang: Column) -> DataFrame:
    """Each row with its language's row of ``table`` (``_band_lang`` and more; stored), nulls where it has none. No language is one task."""
    if table.limit(LANGUAGES + 1).count() <= LANGUAGES:
        return rows.join(F.broadcast(table), lang == F.col("_band_lang"), "left")
    parts = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = rows.withColumn("_own_part", F.pmod(F.xxhash64("n_words", "log_perplexity"), F.lit(PARTS)).cast("int"))
    return spread.join(parts, (lang == F.col("_band_lang")) & (F.col("_own_part") == F.col("_part")), "left").drop("_part", "_own_part")


def bands(scored: DataFrame, lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """(_band_lang, and for each score its median ``_middle_``, and the reach of the band ``_below_`` and ``_above_``) of every
    language, over its documents that pass the plain rules; stored, one row a language. A null language counts as the empty one."""
    own = scored.where(~F.col("base_failed")).select(F.coalesce(F.col(lang), F.lit("")).alias("_its"), "n_words", room().alias("_room"), *SCORES)
    middles = stored(own.groupBy(F.col("_its").alias("_band_lang")).agg(*[F.percentile(F.round(c, digits), 0.5).alias(f"_middle_{c}") for c, (digits, _) in SCORES.items()]))
    apart = _by_language(own, middles, F.col("_its"))
    away = {c: F.round((F.col(c) - F.col(f"_middle_{c}")) / F.col("_room"), digits) for c, (digits, _) in SCORES.items()}
    rows = apart.groupBy("_band_lang", *[f"_middle_{c}" for c in SCORES]).agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{c}") for c, x in away.items()])
    reach = lambda x, least: F.lit(width) * F.greatest(x / QUARTILE, F.lit(least))
    sides = [(reach(-F.col(f"_q_{c}")[0], least).alias(f"_below_{c}"), reach(F.col(f"_q_{c}")[1], least).alias(f"_above_{c}")) for c, (_, least) in SCORES.items()]
    return stored(rows.select("_band_lang", *[f"_middle_{c}" for c in SCORES], *[x for pair in sides for x in pair]))


def within() -> Column:
    inside = ~F.col("base_failed")
    for c in SCORES:
        away = (F.col(c) - F.col(f"_middle_{c}")) / room()
        inside &= F.coalesce(away.between(-F.col(f"_below_{c}"), F.col(f"_above_{c}")), F.lit(True))
    return inside


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """doc_id, the measures, base_failed, kept, log_perplexity and the band, one row per input row, repeated ones included.

    Null, empty and blank texts fail the plain rules. A null language is one of its own. Equal scores get equal verdicts; a score on its band's edge is kept."""
    model = fit(docs, text)
    scored = stored(measured(docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text")), model, "_text").drop("_text"))
    joined = _by_language(scored, bands(scored, "_lang", width), F.coalesce("_lang", F.lit("")))
    return joined.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", within().alias("kept"),
        "log_perplexity", (F.col("_middle_log_perplexity") - F.col("_below_log_perplexity")).alias("band_low"), (F.col("_middle_log_perplexity") + F.col("_above_log_perplexity")).alias("band_high"),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged, whatever their names. Texts are scored once and stored with their scores; none is shuffled."""
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    its_text, its_lang = (f"_c{docs.columns.index(c)}" for c in (text, lang))
    scored = stored(measured(plain, fit(docs, text), its_text))
    joined = _by_language(scored, bands(scored, its_lang, width), F.coalesce(its_lang, F.lit("")))
    return joined.where(within()).select(*plain.columns).toDF(*docs.columns)
