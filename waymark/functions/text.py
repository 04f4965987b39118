"""Cleaning and tokenising addresses with built-in functions; every function takes and gives columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters beyond A-Z that address words may hold, French and Polish capitals.
LETTERS = "ÀÂĀÆÇÉÈÊËÎÏÔŌŒÙÛÜŸĄĆĘŁŃÓŚŹŻ"


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and their base letters, from Unicode's decompositions; and letters with a stroke."""
    pairs = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t"}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _plain_letters()
#: Letters that become two.
DOUBLE = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ẞ": "SS", "ß": "ss", "Þ": "TH", "þ": "th"}


def unaccent(c: Column) -> Column:
    c = F.translate(c, MARKED, PLAIN)
    for letter, plain in DOUBLE.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def clean_input(c: Column) -> Column:
    """Upper case without accents; each run of other characters than letters and digits is one space; no space at the ends."""
    return F.trim(F.regexp_replace(unaccent(F.upper(c)), "[^A-Z0-9]+", " "))


def clean_input_unicode(c: Column) -> Column:
    """As :func:`clean_input`, but accented letters stay."""
    return F.trim(F.regexp_replace(F.upper(c), f"[^A-Z0-9{LETTERS}]+", " "))


def clean_reference(c: Column) -> Column:
    """Upper case; runs of punctuation are one space, then the first double space is one."""
    spaced = F.regexp_replace(F.upper(c), r"[\-.,;:_()!]+", " ")
    return F.trim(F.regexp_replace(spaced, "(?s)^(.*?)  ", "$1 "))


def split_tokens(c: Column) -> Column:
    """Tokens between single spaces; empty ones are kept."""
    return F.split(c, " ")


def phrase_tokens(c: Column) -> Column:
    """Tokens of a cleaned reference address for phrases; punctuation at the ends leaves empty tokens."""
    return F.split(F.regexp_replace(F.trim(c), f"[^A-Z0-9{LETTERS}]+", " "), " ")


def _null_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def numeric_tokens_input(c: Column) -> Column:
    """Numbers with one letter after them at most; null if there are none."""
    return _null_if_empty(F.regexp_extract_all(c, F.lit("[0-9]+[A-Z]?"), F.lit(0)))


def numeric_tokens_reference(c: Column) -> Column:
    """Whole tokens that hold a digit."""
    return F.filter(split_tokens(c), lambda t: t.rlike("[0-9]"))


def numeric_tokens_legacy(c: Column) -> Column:
    """As :func:`numeric_tokens_reference`; null if there are none."""
    return _null_if_empty(numeric_tokens_reference(c))


def alpha_tokens(c: Column) -> Column:
    """Runs of A-Z; null if there are none."""
    return _null_if_empty(F.regexp_extract_all(c, F.lit("[A-Z]+"), F.lit(0)))
