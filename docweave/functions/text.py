"""Column functions on text: white space, folding, label and key spelling, tokens."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in Unicode terms, as a Java character class body.  The information
#: separators U+001C..U+001F count too.
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
#: A word-punctuation token: a run of letters, digits and underscores, or a run of
#: anything else that is not white space.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]+"


def _accent_table() -> tuple[str, str]:
    """Every precomposed letter that decomposes to one base letter, and that letter."""
    source, target = [], []
    for point in range(0xC0, 0x2000):
        char = chr(point)
        base = [c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source) + "đĐ", "".join(target) + "dD"


_ACCENTED, _PLAIN = _accent_table()


def collapse(col: Column) -> Column:
    """Blanks of any kind collapsed to one space and trimmed; null stays null."""
    return F.trim(F.regexp_replace(col, rf"[{BLANK}]+", " "))


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(col: Column) -> Column:
    """Canonical composition.  Only rows that hold a combining mark or a singleton
    leave the JVM; the rest pass through untouched."""
    risky = F.rlike(col, F.lit(r"[\p{M}̀-ͅʹ;·ᄀ-ᇿἀ-῿ - ΩKÅ豈-﫿]"))
    return F.when(risky, F.pandas_udf(_nfc, "string")(F.when(risky, col))).otherwise(col)


def clean(col: Column) -> Column:
    """NFC plus collapsed white space."""
    return collapse(nfc(col))


def strip_accents(col: Column) -> Column:
    """Accents removed in the JVM, letter case kept; đ becomes d."""
    return F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), r"\p{M}+", "")


def fold(col: Column) -> Column:
    """Lower case without accents and with collapsed blanks: the form labels are matched in."""
    return strip_accents(F.lower(collapse(col)))


def label_key(col: Column) -> Column:
    """A label's spelling-independent form: lower case, words joined by ``_``.

    Letter case, outer blanks and ``-``, ``_`` or blanks between words make no
    difference; null and blank labels give null.
    """
    words = F.regexp_replace(F.lower(col), rf"[{BLANK}_\-]+", "_")
    return F.nullif(F.trim(words, F.lit("_")), F.lit(""))


def compact_key(col: Column) -> Column:
    """A key without any separators, lower case; null and empty give null."""
    return F.nullif(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def token_count(col: Column) -> Column:
    """Number of word-punctuation tokens; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(TOKEN)), F.lit(0)).cast("long")


def matched_keywords(col: Column, words: list[str]) -> Column:
    """The ``words`` contained in the lower-cased text, in list order."""
    lowered = F.lower(col)
    hits = [F.when(F.contains(lowered, F.lit(w.lower())), F.lit(w)) for w in words]
    return F.array_compact(F.array(*hits))


def safe_csv(col: Column) -> Column:
    """Text a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(F.rlike(F.ltrim(F.regexp_replace(col, rf"^[{BLANK}]+", "")), F.lit(r"^[=+@\-]")), F.concat(F.lit("'"), col)).otherwise(col)


def unreadable(col: Column) -> Column:
    """Whether the text carries a marker for characters that could not be read."""
    return F.rlike(col, F.lit(r"�|\[UNREADABLE\]|\[ILLEGIBLE\]"))


def transport_safe(col: Column) -> Column:
    """Whether every character may stand in XML 1.0."""
    return ~F.rlike(col, F.lit(r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]"))


assert sys.maxunicode == 0x10FFFF
