"""The n-gram model of the quality rules."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import quality
from muniframe.llm.queries import QUERIES


def ngrams(text):
    """The last five bytes up to every byte of the text's words and the blank after each."""
    padded = b"    " + "".join(w + " " for w in brute.BLANK_WORDS.findall(text)).encode()
    return {padded[i - 4 : i + 1] for i in range(4, len(padded))}


def test_no_ngram_is_lost(spark):
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300)),) for _ in range(80)]
    want = set().union(*(ngrams(t) for t, in rows))
    model = quality.fit(spark.createDataFrame(rows, "text string").repartition(3)).value
    assert len(model.ngrams[5][0]) == len(want) > 100_000


def test_word_order_counts(spark):
    model = quality.fit(spark.createDataFrame([("the cat sat on the mat and the dog sat on the log " * 40,), ("",), (None,), ("a",)], "text string"))
    rows = [(0, "the cat sat on the log " * 10), (1, "log the on sat cat the " * 10), (2, "a"), (3, None)]
    scores = {r.id: r.log_perplexity for r in quality.measured(spark.createDataFrame(rows, "id long, text string"), model).collect()}
    assert scores[0] < scores[1] and scores[2] is not None and scores[3] is None


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = QUERIES["op3_kneser_ney_quality"](spark, sf).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    junk, clean = [not r.kept for r in judged if r.quality == 0], [r.kept for r in judged if r.quality == 1]
    print("junk rejected", sum(junk) / len(junk), "of", len(junk), "clean kept", sum(clean) / len(clean), "of", len(clean))
    assert sum(junk) >= 0.8 * len(junk) and sum(clean) >= 0.99 * len(clean)
