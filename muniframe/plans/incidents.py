"""Incident cleaning: unify extracts, standardise, classify natures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.dates import DAY_MONTH_YEAR, TIMESTAMP_FRACTION, hour_minute, parse_date, period_of_day
from ..functions.lookup import vocabulary_frame
from ..functions.text import clean_text, clean_words, has_text, map_binary, map_weekday_pt, standard_names
from ..operators.joins import common_keys, union_schemas

VAGUE = "__vague"


def split_date(
    df: DataFrame, col: str, fmt: str, names: Sequence[str] = ("OCORRENCIA_ANO", "OCORRENCIA_MES", "OCORRENCIA_DIA"), drop: bool = True
) -> DataFrame:
    """Year, month and day columns; rows whose date does not parse are dropped."""
    if col not in df.columns:
        return df
    parsed = df.withColumn("__date", parse_date(F.col(col), fmt)).where(F.col("__date").isNotNull())
    d = F.col("__date")
    out = parsed.withColumns({names[0]: F.year(d).cast("bigint"), names[1]: F.month(d).cast("bigint"), names[2]: F.dayofmonth(d).cast("bigint")})
    return out.drop("__date", *([col] if drop else []))


def invalid_dates(df: DataFrame, col: str, fmt: str, row_number: str) -> DataFrame:
    """Non-empty values that do not parse, with their line in the file (header is line 1)."""
    text = F.trim(F.col(col))
    bad = df.where(text.isNotNull() & (text != "") & parse_date(F.col(col), fmt).isNull())
    return bad.select((F.col(row_number) + 1).alias("line"), F.col(col).alias("value"))


def split_time(df: DataFrame, col: str) -> DataFrame:
    """Replace an ``HH:MM:SS`` column by hour and minute (null when invalid)."""
    if col not in df.columns:
        return df
    hour, minute = hour_minute(F.col(col))
    return df.withColumns({f"{col}_HORA": hour.cast("bigint"), f"{col}_MINUTO": minute.cast("bigint")}).drop(col)


def unify_incidents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and current extract on one schema, dates split (the dashed header row fails to parse and goes)."""
    old = split_date(old, vocab.DATE_COLUMN, TIMESTAMP_FRACTION).drop("ATENDIMENTO_ANO")
    new = split_date(new, vocab.DATE_COLUMN, DAY_MONTH_YEAR)
    return union_schemas(old, new)


def overlapping_codes(old: DataFrame, new: DataFrame, year: int = 2022, month: int = 11) -> DataFrame:
    """Incident codes present in both (date-split) extracts for one month."""
    where = (F.col("OCORRENCIA_ANO") == year) & (F.col("OCORRENCIA_MES") == month)
    return common_keys(old, new, vocab.CODE_COLUMN, where)


def category_index(categories: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """value -> category; a value under two categories is an error."""
    index: dict[str, str] = {}
    clashes = set()
    for category, values in categories.items():
        for value in values:
            if index.setdefault(value, category) != category:
                clashes.add(value)
    if clashes:
        raise ValueError(f"values under more than one category: {sorted(clashes)}")
    return index


def composed_vocabulary(categories: Mapping[str, Iterable[str]], fixes: Mapping[str, str], drop_if: Iterable[str]) -> dict[str, str]:
    """cleaned value -> category, typo fixes applied; values that drop the row map to ``VAGUE``."""
    index = {**category_index(categories), **{v: VAGUE for v in drop_if}}
    fixed = {raw: index.get(target) for raw, target in fixes.items()}
    return {k: v for k, v in {**index, **fixed}.items() if v is not None}


def first_category(
    df: DataFrame, cols: Sequence[str], categories: Mapping[str, Iterable[str]], fixes: Mapping[str, str], drop_if: Iterable[str], out: str = "categoria",
    words: Sequence[str] = (),
) -> DataFrame:
    """Category of the first column with a known value; rows without any value or with a vague one are dropped.

    Fixes, categories and drop list form one vocabulary, so each column is cleaned once
    and looked up once in a broadcast hash table of Python-literal size. ``words`` names
    columns that already hold the cleaned values of rows with some text; otherwise
    helper columns ``__n<i>`` are added.
    """
    vocabulary = composed_vocabulary(categories, fixes, drop_if)
    keys = list(words)
    if not keys:
        present = [c for c in cols if c in df.columns]
        df = df.where(any_text(present))
        keys = [f"__n{i}" for i in range(len(present))]
        df = df.withColumns({k: clean_words(F.col(c)) for k, c in zip(keys, present)})
    found = []
    for i, key in enumerate(keys):
        known = F.broadcast(vocabulary_frame(df.sparkSession, vocabulary, f"__k{i}", f"__c{i}"))
        df = df.join(known, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__c{i}"))
    is_vague = reduce(lambda a, b: a | b, [F.coalesce(c == VAGUE, F.lit(False)) for c in found])
    return df.where(~is_vague).withColumn(out, F.coalesce(*found)).drop(*[f"__c{i}" for i in range(len(keys))])


def any_text(cols: Sequence[str]) -> Column:
    """Some column has text left after cleaning, told from the raw text."""
    return reduce(lambda a, b: a | b, [has_text(F.col(c)) for c in cols])


def _helpers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("__n")]


def classify_first_match(
    df: DataFrame,
    cols: Sequence[str] = vocab.NATURE_COLUMNS,
    categories: Mapping[str, Iterable[str]] = vocab.NATURE_CATEGORIES,
    fixes: Mapping[str, str] = vocab.NATURE_FIXES,
    drop_if: Iterable[str] = vocab.UNDETERMINED_NATURES,
    strict: bool = True,
    words: Sequence[str] = (),
) -> DataFrame:
    """Exclusive 0/1 column per category. ``strict`` fails on a row without category."""
    tagged = first_category(df, cols, categories, fixes, drop_if, "__categoria", words)
    if strict:
        values = F.array_join(F.array_remove(F.array(*(words or _helpers(tagged))), ""), " | ")
        tagged = tagged.where(F.assert_true(F.col("__categoria").isNotNull(), F.concat(F.lit("no category for: "), values)).isNull())
    flags = {c: F.coalesce((F.col("__categoria") == c).cast("int"), F.lit(0)) for c in categories}
    return tagged.withColumns(flags).drop("__categoria", *_helpers(tagged))


def unmapped_values(
    df: DataFrame, cols: Sequence[str], categories: Mapping[str, Iterable[str]], fixes: Mapping[str, str], drop_if: Iterable[str]
) -> DataFrame:
    """Distinct cleaned values of rows that end up without a category."""
    tagged = first_category(df, cols, categories, fixes, drop_if, "__categoria").where(F.col("__categoria").isNull())
    values = tagged.select(F.explode(F.array(*_helpers(tagged))).alias("value"))
    return values.where(F.col("value") != "").distinct()


def clean_incidents(df: DataFrame, strict: bool = True) -> DataFrame:
    """The whole cleaning job: projections and broadcast lookups, no shuffle.

    Rows without a place or without any nature go first, on a cheap test of the raw
    text that reaches the scan. The place is then an inner join with the dictionary of
    valid spellings, which maps and filters at once.
    """
    natures = [c for c in vocab.NATURE_COLUMNS if c in df.columns]
    df = df.where(has_text(F.col(vocab.UNIT_COLUMN)) & any_text(natures))

    # Place and natures are join keys and output columns: cleaned once, into columns of their own.
    words = {c: f"__w_{c}" for c in (vocab.UNIT_COLUMN, *natures)}
    others = [c for c in vocab.TEXT_COLUMNS if c in df.columns and c not in words]
    df = df.withColumns({**{w: clean_words(F.col(c)) for c, w in words.items()}, **{c: clean_text(F.col(c)) for c in others}})
    names = standard_names((*vocab.INVALID_UNITS, *vocab.METROPOLITAN_UNITS), vocab.UNIT_FIXES, vocab.OFFICIAL_UNITS)
    official = F.broadcast(vocabulary_frame(df.sparkSession, names, words[vocab.UNIT_COLUMN], "__official"))
    df = df.join(official, words[vocab.UNIT_COLUMN])
    df = df.withColumns({vocab.UNIT_COLUMN: F.col("__official"), **{c: F.nullif(F.col(words[c]), F.lit("")) for c in natures}})

    df = df.withColumns({c: map_binary(F.col(c)) for c in vocab.BINARY_COLUMNS if c in df.columns})
    if vocab.WEEKDAY_COLUMN in df.columns:
        df = df.withColumn(vocab.WEEKDAY_COLUMN, map_weekday_pt(F.col(vocab.WEEKDAY_COLUMN)))
    df = split_time(df, vocab.HOUR_COLUMN)
    hour = f"{vocab.HOUR_COLUMN}_HORA"
    if hour in df.columns:
        df = df.withColumns(period_of_day(F.col(hour)))
    classified = classify_first_match(df, strict=strict, words=[words[c] for c in natures])
    return classified.drop("__official", *words.values(), *vocab.DROP_COLUMNS)
