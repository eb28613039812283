import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from muniframe.functions import (
    argmax_name, any_positive, cast_columns, clean_text, clean_words, clip, has_text, keep_or, map_binary, map_weekday_pt, normalize_name, parse_census_number, parse_ptbr_number,
    period_of_day, round_half_even, row_mean, row_sum, standard_names, standardize_category, strict_long, to_number,
)
from muniframe.functions.dates import DAY_MONTH_YEAR, TIMESTAMP_FRACTION, hour_minute, parse_date


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def ascii_words(value):
    """Independent statement of the cleaning rule, one character at a time."""
    kept = []
    for ch in value.lower():
        for part in unicodedata.normalize("NFKD", ch):
            if ord(part) < 128:
                kept.append(part if part.isalnum() else " ")
    return " ".join("".join(kept).split()) or None


def test_clean_text_every_latin1_character(spark):
    values = [f"a{chr(cp)}b" for cp in range(1, 0x100)]
    assert apply(spark, values, clean_text) == [ascii_words(v) for v in values]


def test_cheap_text_test_agrees_with_cleaning(spark):
    values = [chr(cp) for cp in range(1, 0x100)] + ["", " - ", None, "--a"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.where(has_text(F.col("v")) != clean_text(F.col("v")).isNotNull()).count() == 0
    assert df.where(clean_words(F.col("v")).isNull()).count() == 0


def test_standard_names_agrees_with_expression(spark):
    discard, mapping, allowed = ["ni", "cic"], {"cic": "centro", "cc": "centro", "z": "moon", "centro": "batel"}, ["centro", "batel"]
    names = standard_names(discard, mapping, allowed)
    values = ["centro", "batel", "cic", "cc", "z", "ni", "moon"]
    got = apply(spark, values, lambda c: standardize_category(c, discard, mapping, allowed))
    assert got == [names.get(v) for v in values] == ["batel", "batel", None, "centro", None, None, None]


def test_clean_text_unicode_mode(spark):
    values = ["Ｆｕｌｌ", "ﬁm", "Ⅳ", "naïve – café", "ŁódźŠ", "日本x", "…", None, ""]
    assert apply(spark, values, lambda c: clean_text(c, unicode=True)) == [None if v is None else ascii_words(v) for v in values]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0xFF, exclude_categories=["Cs"]), max_size=30), min_size=30, max_size=60))
def test_clean_text_random_latin1(spark, values):
    assert apply(spark, values, clean_text) == [ascii_words(v) for v in values]


def test_double_encoded_names_keep_their_odd_image(spark):
    raw = [w.encode().decode("latin-1") for w in ("ameaça", "Óbito", "patrimônio", "seqüestro", "glória")]
    assert apply(spark, raw, clean_text) == ["ameaaa", "abito", "patrima nio", "seqa14estro", "gla3ria"]


def test_normalize_name_keeps_punctuation(spark):
    got = apply(spark, ["  Água-Verde  d'Oeste ", "ALTO DA\tRUA XV", None], lambda c: normalize_name(c, {"alto da rua xv": "alto da xv"}))
    assert got == ["agua-verde d'oeste", "alto da xv", None]


def test_standardize_category_discard_wins(spark):
    got = apply(spark, ["Centro", "cic", "NI", "moon", None], lambda c: standardize_category(c, ["ni", "cic"], {"cic": "centro"}, ["centro"]))
    assert got == ["centro", None, None, None, None]


def test_binary_words(spark):
    assert apply(spark, ["SIM", "s", " 1.0", "0.0", "-----", "true", "T", None, "1", "não"], map_binary) == [1, 0, 1, 0, 0, 0, 1, 0, 1, 0]


def test_weekday_names(spark):
    assert apply(spark, ["Domingo", "TERÇA", "sábado ", "segunda-feira", None], map_weekday_pt) == [1, 3, 7, 0, 0]


def test_numbers(spark):
    assert apply(spark, ["X", "", "nan", " 1,5 ", "2", "inf", "1d", None], parse_census_number) == [None, None, None, 1.5, 2.0, None, None, None]
    assert apply(spark, ["1.234,56", " 7 ", "abc"], parse_ptbr_number) == [1234.56, 7.0, None]
    assert apply(spark, ["1e3", ".5", "5.", "NaN", "-2"], to_number) == [1000.0, 0.5, 5.0, None, -2.0]


def test_strict_long_fails_on_null(spark):
    assert apply(spark, ["1", "2.0"], strict_long) == [1, 2]
    with pytest.raises(Exception, match="not numeric"):
        apply(spark, ["1", None], strict_long)
    df = spark.createDataFrame([("3", "x")], "a string, b string")
    assert cast_columns(df, ["a"], ["b"]).collect()[0] == (3, None)


def test_dates(spark):
    out = apply(spark, ["2020-01-02 03:04:05.000", "2020-1-2 3:4:5.5", "2020-01-02", "-----", None], lambda c: parse_date(c, TIMESTAMP_FRACTION).isNotNull())
    assert out == [True, True, False, False, False]
    out = apply(spark, ["1/2/2024", "01/02/2024", "31/02/2024", "2024-02-01"], lambda c: F.date_format(parse_date(c, DAY_MONTH_YEAR), "yyyy-MM-dd"))
    assert out == ["2024-02-01", "2024-02-01", None, None]
    assert apply(spark, ["24:00:00", "23:59:59", "7:5:0", None], lambda c: hour_minute(c)[0]) == [None, 23, 7, None]


def test_period_flags(spark):
    names = list(period_of_day(F.lit(1)))
    rows = spark.createDataFrame([(h,) for h in [0, 5, 6, 12, 23, None]], "h int").select(*[c.alias(n) for n, c in period_of_day(F.col("h")).items()]).collect()
    assert [[n for n in names if r[n] == 1] for r in rows[:5]] == [["MADRUGADA"], ["MADRUGADA"], ["MANHA"], ["TARDE"], ["NOITE"]]
    assert all(v is None for v in rows[5])


def test_rounding_and_clipping(spark):
    assert apply(spark, [0.5, 1.5, 2.5, -0.5], round_half_even, "double") == [0.0, 2.0, 2.0, 0.0]
    assert apply(spark, [-1.0, 5.0, None], lambda c: clip(c, 0.0, 3.0), "double") == [0.0, 3.0, None]
    # A null comparison takes the other value.
    assert apply(spark, [None, 5.0, 1.0], lambda c: keep_or(c, c <= 3, F.lit(3.0)), "double") == [3.0, 3.0, 1.0]


def test_row_functions(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (0.0, 0.0, 0.0), (0.0, 2.0, 2.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    rows = df.select(row_sum(*cols), row_mean(*cols), any_positive(*cols), argmax_name("abc")).collect()
    assert [tuple(r) for r in rows] == [(4.0, 2.0, 1, "c"), (0.0, None, 0, "a"), (0.0, 0.0, 0, "a"), (4.0, 4 / 3, 1, "b")]


def test_vocabulary_is_cleaned_and_disjoint():
    from muniframe import vocab
    from muniframe.plans.incidents import category_index

    index = category_index(vocab.NATURE_CATEGORIES)
    assert len(index) == sum(map(len, vocab.NATURE_CATEGORIES.values()))
    every = [*index, *vocab.NATURE_FIXES, *vocab.NATURE_FIXES.values(), *vocab.UNIT_FIXES, *vocab.OFFICIAL_UNITS]
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", v) for v in every)
