"""Text helpers that follow web (ECMAScript) rules rather than Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyledger.functions.steps import let

# White space as the web platform defines it. Java's \s lacks the non-ASCII ones.
WHITE_SPACE = r"\s   -     　﻿"

# Java's \b counts accented letters as word characters; these do not.
WORD_START = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
WORD_END = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def word_pattern(body: str) -> str:
    """A case-insensitive pattern for ``body`` between ASCII word boundaries."""
    return f"(?i){WORD_START}(?:{body}){WORD_END}"


def web_trim(col: Column) -> Column:
    """Trim web white space from both ends."""
    return F.regexp_replace(col, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def collapse_space(col: Column) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(col, f"[{WHITE_SPACE}]+", " ")


def blank_to_null(col: Column) -> Column:
    return let(col, lambda c: F.when(c != "", c))


def first_text(*cols: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(web_trim(c)) for c in cols])


def quoted(col: Column) -> Column:
    """The value as a JSON string literal, for use in reasons."""
    out = F.regexp_replace(col, r"\\", r"\\\\")
    for raw, escaped in (('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        out = F.regexp_replace(out, raw, escaped)
    return F.concat(F.lit('"'), out, F.lit('"'))


def snippet(col: Column, chars: int = 400) -> Column:
    """The opening ``chars`` characters with white space collapsed; null counts as empty."""
    return F.left(collapse_space(F.coalesce(col, F.lit(""))), F.lit(chars))
