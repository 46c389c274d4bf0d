"""Text normal forms as JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented_latin() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to a base letter and marks, and those base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs += [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0x1E00, 0x1F00)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower() and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented_latin()


def header_form(text: Column) -> Column:
    """Lower case, without accents or punctuation, single-spaced: the form in which header wordings are compared.

    Null stays null; a text without letters or digits is ''.
    """
    plain = F.regexp_replace(F.lower(text), r"\p{M}+", "")
    plain = F.translate(F.translate(plain, _FROM, _TO), "ıłø", "ilo")
    plain = F.regexp_replace(plain, "ß", "ss")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def formula_safe(cell: Column) -> Column:
    """A text cell for spreadsheets: a cell whose first visible character starts a formula gets a leading apostrophe."""
    return F.when(cell.rlike(r"^[\s]*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)
