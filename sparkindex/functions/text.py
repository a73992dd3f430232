"""Scalar functions on text, all of them expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like(text: Column, pattern: str) -> Column:
    """LIKE with `\\` as escape and case ignored for A-Z only; wildcards in the pattern count."""
    lowered = "".join(c.lower() if c in _UPPER else c for c in pattern)
    return F.like(ascii_lower(text), F.lit(lowered), F.lit("\\")) if _escapes_are_valid(lowered) else F.lit(False)


def _escapes_are_valid(pattern: str) -> bool:
    """A backslash must stand before a wildcard or another backslash."""
    at = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            if pattern[at + 1 : at + 2] not in ("%", "_", "\\"):
                return False
            at += 1
        at += 1
    return True


def escaped_like(text: str) -> str:
    """The text with its wildcards escaped, for callers who want it taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1; 0 for an empty text."""
    return F.when(F.char_length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4))).cast("int")


def one_line(text: Column) -> Column:
    """White space collapsed and trailing colons removed, as in a signature."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), ":+$", "")


@cache
def _plain_letters() -> tuple[str, str]:
    """Precomposed characters and the letters that are left without their marks."""
    source, target = [], []
    for code in range(0xC0, 0x2FFF):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if bare != c and len(bare) == 1:
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    source, target = _plain_letters()
    return F.lower(F.regexp_replace(F.translate(text, source, target), "\\p{M}", ""))


def folded_text(text: str) -> str:
    source, target = _plain_letters()
    plain = text.translate(str.maketrans(source, target))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def search_tokens(text: Column) -> Column:
    """The letters-and-digits runs of a text, folded; none of a null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
