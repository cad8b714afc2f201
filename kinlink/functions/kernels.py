"""The few text kernels that Spark has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .vocabulary import BLOCKS, CONSONANTS, MATRAS, VOWELS

_VIRAMA, _NASALS, _VISARGA, _OM = "\u094d", "\u0901\u0902", "\u0903", "\u0950"


def fold(text: str) -> str:
    """Compatibility form, lower case, without combining marks."""
    lower = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in unicodedata.normalize("NFKD", lower) if not unicodedata.combining(c))


def to_devanagari(text: str) -> str:
    """Letters of the other Brahmic blocks moved onto the Devanagari block, which has the same layout."""
    table = {base + k: 0x0900 + k for base in BLOCKS.values() for k in range(0x80)}
    return text.translate(table)


def romanise(text: str) -> str:
    """Latin letters for a Brahmic text.

    A consonant keeps its inherent vowel before another consonant or a vowel, loses it before a virama and at a
    word's end, and takes that of a vowel sign. Signs without their consonant stay as they are.
    """
    text = to_devanagari(text)
    out: list[str] = []
    for before, c, after in zip(" " + text, text, text[1:] + " "):
        if c in CONSONANTS:
            out.append(CONSONANTS[c] + ("a" if after in CONSONANTS or after in VOWELS else ""))
        elif c in VOWELS:
            out.append(VOWELS[c])
        elif c in MATRAS:
            out.append(MATRAS[c] if before in CONSONANTS else c)
        elif c in _NASALS:
            out.append("an" if before in CONSONANTS else "n")
        elif c == _VISARGA:
            out.append("ah" if before in CONSONANTS else "h")
        elif c == _OM:
            out.append(" om ")
        elif "०" <= c <= "९":
            out.append(str(ord(c) - ord("०")))
        elif c != _VIRAMA:
            out.append(c)
    return " ".join("".join(out).split())


def script(text: str) -> str:
    """The script of most letters; the one seen first on a tie; Latin without letters."""
    ranges = {"Devanagari": 0x0900, **BLOCKS}
    counts: dict[str, int] = {}
    for c in text:
        name = next((k for k, base in ranges.items() if base <= ord(c) < base + 0x80), "Latin" if c.isalpha() else None)
        if name:
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=counts.get) if counts else "Latin"


def _where(kernel) -> "pd.Series":
    """A kernel over texts that leaves out nulls, which is what the expressions below give for texts that don't need it."""
    return F.pandas_udf(lambda texts: texts.map(kernel, na_action="ignore"), StringType())


def fold_accents(c: Column | str) -> Column:
    """:func:`fold` of a text; a text of ASCII alone is lowered without the kernel. Empty for null."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.coalesce(_where(fold)(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def transliterate(c: Column | str) -> Column:
    """:func:`romanise` of a text; empty for a text without a Brahmic letter, which doesn't reach the kernel."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_where(romanise)(F.when(text.rlike("[\u0900-\u0D7F]"), text)), F.lit(""))


def detect_script(c: Column | str) -> Column:
    """:func:`script` of a text; Latin for a text without a Brahmic letter, which doesn't reach the kernel."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_where(script)(F.when(text.rlike("[\u0900-\u0D7F]"), text)), F.lit("Latin"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity: 1 for equal texts, also empty ones; 0 if only one is empty. Equal pairs of a batch are compared once."""

    @lru_cache(maxsize=256)
    def matcher(y: str) -> SequenceMatcher:
        return SequenceMatcher(None, "", y)  # indexes the second text, which candidates' rows repeat

    @lru_cache(maxsize=None)
    def ratio(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        one = matcher(y)
        one.set_seq1(x)
        return one.ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype=float)
