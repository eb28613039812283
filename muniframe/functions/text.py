"""Text standardisation as native Column expressions.

Inputs are decoded as latin-1, so the default tables cover every character up to
U+00FF. They are derived from Unicode compatibility decomposition by rule, not
listed by hand. ``unicode=True`` widens the same rule to all scripts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .lookup import recode

LATIN1 = range(0x80, 0x100)
WIDE = (range(0x80, 0x3400), range(0xF900, 0xFE00), range(0xFE10, 0x10000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200))
# Python's str.split() whitespace inside latin-1, including controls Java's \s leaves out.
SPACES = r"[\s\x1c-\x1f\x85\xa0]+"


def _ascii_image(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")


def _unmarked_image(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


def _words_image(ch: str) -> str:
    """Lower-cased ASCII image with everything but letters and digits as a space."""
    return "".join(x if x.isalnum() else " " for x in _ascii_image(ch.lower()))


def _lower_unmarked_image(ch: str) -> str:
    return _unmarked_image(ch.lower())


@lru_cache(maxsize=None)
def _latin1_tables(image) -> tuple[str, str, dict[str, str]]:
    """(from, to, multi) over latin-1: one translate() call does every 1:1 case and every deletion."""
    images = {chr(cp): image(chr(cp)) for cp in range(0x100)}
    single = {ch: out for ch, out in images.items() if len(out) == 1 and out != ch}
    deleted = [ch for ch, out in images.items() if not out]
    return "".join([*single, *deleted]), "".join(single.values()), {ch: out for ch, out in images.items() if len(out) > 1}


@lru_cache(maxsize=None)
def _wide_tables(image) -> tuple[str, str, dict[str, str]]:
    """The same over all scripts, without deletions; for lower-cased text."""
    images = {ch: image(ch) for ch in (chr(cp) for block in WIDE for cp in block if not 0xD800 <= cp < 0xE000)}
    single = {ch: out for ch, out in images.items() if len(out) == 1 and out != ch}
    return "".join(single), "".join(single.values()), {ch: out for ch, out in images.items() if len(out) > 1}


def _fold_latin1(c: Column, image) -> Column:
    source, target, multi = _latin1_tables(image)
    for ch, out in multi.items():
        c = F.replace(c, F.lit(ch), F.lit(out))
    return F.translate(c, source, target)


def _fold_wide(c: Column, image) -> Column:
    """Rare multi-letter forms are expanded only in rows that contain one."""
    source, target, multi = _wide_tables(image)
    expanded = F.array_join(F.transform(F.split(c, ""), lambda ch: recode(ch, multi)), "")
    c = F.when(c.rlike("[" + "".join(sorted(multi)) + "]"), expanded).otherwise(c)
    return F.translate(c, source, target)


NOT_ASCII = r"[^\x00-\x7F]+"


def clean_words(c: Column, unicode: bool = False) -> Column:
    """:func:`clean_text` with an empty string where that gives null.

    Never null, so a join on it adds no null filter that would evaluate it again.
    """
    if unicode:
        ascii_only = F.regexp_replace(_fold_wide(F.lower(c), _ascii_image), NOT_ASCII, "")
        spaced = F.regexp_replace(ascii_only, r"[^a-z0-9]+", " ")
    else:
        spaced = F.regexp_replace(F.regexp_replace(_fold_latin1(c, _words_image), NOT_ASCII, ""), " {2,}", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def clean_text(c: Column, unicode: bool = False) -> Column:
    """Lower-case ASCII letters, digits and single spaces; empty becomes null.

    Accents fold to their base letter, characters without an ASCII image are
    deleted (not spaced), every other run of non-alphanumerics becomes one space.
    For latin-1 text one character table does all of it but the collapsing.
    """
    return F.nullif(clean_words(c, unicode), F.lit(""))


@lru_cache(maxsize=1)
def _letter_class() -> str:
    letters = [chr(cp) for cp in LATIN1 if any(x.isalnum() for x in _ascii_image(chr(cp)))]
    return "[A-Za-z0-9" + "".join(letters) + "]"


def has_text(c: Column) -> Column:
    """True where :func:`clean_text` (latin-1) is not null, at the price of finding one letter."""
    return F.coalesce(c.rlike(_letter_class()), F.lit(False))


def normalize_name(c: Column, aliases: Mapping[str, str] | None = None, unicode: bool = False) -> Column:
    """Lower-case, drop combining marks only (punctuation stays), collapse spaces, apply aliases."""
    if unicode:
        unmarked = F.regexp_replace(_fold_wide(F.lower(c), _unmarked_image), r"\p{M}+", "")
    else:
        unmarked = _fold_latin1(c, _lower_unmarked_image)
    return recode(F.trim(F.regexp_replace(unmarked, SPACES, " ")), aliases or {})


def standardize_category(
    c: Column,
    discard: Iterable[str],
    mapping: Mapping[str, str],
    allowed: Iterable[str] | None,
    clean: bool = True,
) -> Column:
    """Clean, drop discarded values, fix known typos, keep only allowed names.

    The discard list wins over the typo map. Anything else becomes null.
    """
    value = clean_text(c) if clean else c
    fixed = recode(value, mapping)
    kept = F.when(fixed.isin(sorted(allowed)), fixed) if allowed is not None else fixed
    return F.when(~value.isin(sorted(discard)), kept)


def standard_names(discard: Iterable[str], mapping: Mapping[str, str], allowed: Iterable[str]) -> dict[str, str]:
    """:func:`standardize_category` as one dictionary: cleaned name -> official name."""
    allowed = set(allowed)
    names = {name: mapping.get(name, name) for name in (*allowed, *mapping)}
    return {raw: name for raw, name in names.items() if raw not in set(discard) and name in allowed}


TRUE_WORDS = ("sim", "y", "t", "1")
# Day name -> day number, Sunday first.
WEEKDAYS_PT = {"domingo": 1, "segunda": 2, "terca": 3, "quarta": 4, "quinta": 5, "sexta": 6, "sabado": 7}


def map_binary(c: Column) -> Column:
    """1 for ``1.0`` and the cleaned words sim/y/t/1, otherwise 0 (null included)."""
    is_true = (F.lower(F.trim(c)) == "1.0") | clean_text(c).isin(*TRUE_WORDS)
    return F.when(F.coalesce(is_true, F.lit(False)), 1).otherwise(0)


def map_weekday_pt(c: Column) -> Column:
    """Sunday = 1 ... Saturday = 7 from a Portuguese day name, 0 when unknown."""
    from .lookup import lookup

    return lookup(clean_text(c), WEEKDAYS_PT, default=0)
