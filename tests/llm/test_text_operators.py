"""Quality, decontamination, chat and near-duplicates against plain Python on the small tables and on odd rows."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from muniframe.llm import chat, decontaminate, neardup, quality
from muniframe.llm.queries import ORACLE_SQL, QUERIES
from oracle import connect, difference

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ODD = [None, "", " \n\t", "one", "One", "ONE two", "one TWO", "é ß 漢字 €", "a\x00b c", LONG, LONG, LONG + "x", "x\ny\nx\n\nx", "<|turn|> \\ <\\| <| \\\\<|"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "x", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, kept int").cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_quality_counts(spark, odd):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = brute.table("documents")
    got = QUERIES["op3_kneser_ney_quality"](spark, SF)
    assert rows_of(got.select(columns)) == sorted((d["doc_id"], *brute.base_quality(d["text"])) for d in docs)
    assert got.where("base_failed and kept").count() == 0
    assert rows_of(quality.judge(odd).select(columns)) == sorted((i, *brute.base_quality(t)) for i, t in enumerate(ODD))
    assert quality.judge(odd.limit(0)).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns


def test_quality_model_sums_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(sum((rng.integers(97, 101, 400) << (8 * k) for k in range(3)), np.zeros(400, np.int64)))
    model = quality.Model(keys, rng.integers(1, 9, len(keys)), order=3)
    for context in (0x6161, 0x6264, 0x7A7A):
        every = np.exp(model.log_p(np.array([(context << 8) | c for c in range(256)])))
        assert every.sum() == pytest.approx(1 - 1 / 257, abs=0.02) or every.sum() == pytest.approx(1, abs=0.02)


def test_quality_keeps_clean_and_drops_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = QUERIES["op3_kneser_ney_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    rows = judged.select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)


def test_decontamination(spark, odd):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs, items = brute.table("documents"), brute.table("benchmark")
    want = brute.leaks([(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in items])
    got = QUERIES["op7_suffix_array_decontamination"](spark, SF)
    assert rows_of(got.select(columns)) == want and any(w[5] for w in want)
    few = [(1, "one two"), (2, None), (3, "..."), (4, " ".join(LONG.split()[3:15])), (5, "ONE, TWO"), (6, "漢字")]
    bench = spark.createDataFrame(few, "item_id long, text string")
    want = brute.leaks(list(enumerate(ODD)), few)
    assert rows_of(decontaminate.report(odd, bench).select(columns)) == want
    assert rows_of(decontaminate.report(odd, bench, block_bytes=8).select(columns)) == want
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(odd.limit(0), bench).count() == 0


def test_near_groups(spark, odd):
    docs = brute.table("documents", "/root/testdata/sf0.01")
    got = QUERIES["op10_min_max_near_dup"](spark, "/root/testdata/sf0.01")
    want = brute.near_groups([(d["doc_id"], d["text"]) for d in docs])
    assert rows_of(got) == want and len({w[2] for w in want}) < len(want)
    assert rows_of(neardup.near_groups(odd)) == brute.near_groups(list(enumerate(ODD)))
    assert neardup.near_groups(odd.limit(0)).count() == 0
    twice = odd.union(odd)
    assert neardup.near_groups(twice).count() == 2 * len(ODD)
    assert neardup.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize("block", [7, 4000])
def test_near_strays_in_blocks(spark, monkeypatch, block):
    """Copies with differing edits: many reach their leader only through others, or not at all."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    rows = []
    for k in range(120):
        words = [f"w{i}" for i in range(60)]
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(60)] = f"z{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    want = brute.near_groups(rows)
    assert rows_of(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want and 1 < len({w[2] for w in want}) < 100


def test_near_chain(spark):
    """Edited copies that reach each other only through others are one group."""
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(["x%d" % j if j < 4 * k else w for j, w in enumerate(base)])) for k in range(12)]
    assert rows_of(neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_groups(rows)


def test_chat(spark):
    assert difference(QUERIES["op9_chat_format"](spark, SF), connect(SF), ORACLE_SQL["op9_chat_format"]) is None
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "a\n<|says|>\\") for t in ODD)]
    rows += [(2, None, "assistant", "x"), (2, None, "assistant", "x"), (None, 1, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(turns)
    assert [chat.parsed(r.formatted) for r in made.where("conv_id = 1").orderBy("turn").collect()] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    said = [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert back[1].turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in said))
    assert back[1].loss_sha256 == brute.sha("".join(t for r, t in said if r == "assistant"))
    assert back[2].n_turns == 2 and back[None].loss_chars == 1
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
