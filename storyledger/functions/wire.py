"""Wire-agency detection and verbatim quotes."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.steps import Stage, add_steps
from storyledger.functions.text import WORD_START, web_trim, word_pattern

# Agencies in the order they are tried, with the names they go by.
AGENCIES = (
    ("PTI", r"Press Trust of India|PTI(?:-Bhasha)?"),
    ("ANI", r"Asian News International|ANI"),
    ("Reuters", r"Thomson Reuters|Reuters"),
    ("AFP", r"Agence France[-\s]?Presse|AFP"),
    ("IANS", r"Indo[-\s]?Asian News Service|IANS"),
    ("Bloomberg", r"Bloomberg"),
    ("AP", r"Associated Press"),
)
# Words that introduce a byline, and the parenthesised dateline form.
BYLINE_LEAD = (
    rf"(?i){WORD_START}(?:by|source|agency|inputs? from|with inputs from|courtesy)\s*[:\-–—]?\s*$"
)
DATELINE = r"(?i)\(\s*(PTI|ANI|Reuters|AFP|IANS|Bloomberg|AP)\s*\)"
HEAD_CHARS = 400
VERBATIM_MIN_CHARS = 200

ANY_AGENCY = word_pattern("|".join(names for _, names in AGENCIES))
NO_HIT = "struct<agency:string,matched:string>"


def leading_words(text: Column, chars: int = HEAD_CHARS) -> Column:
    """The opening ``chars`` characters without a word that they would cut: a part of a word is no name."""
    head = F.left(text, F.lit(chars))
    cut = F.substring(text, chars + 1, 1).rlike("[A-Za-z0-9_]")
    return F.when(cut, F.regexp_replace(head, "[A-Za-z0-9_]+$", "")).otherwise(head)


def _find_agency(text: Column) -> Column:
    """The first agency of the list that ``text`` names. One scan settles the usual 'none'."""
    hits = [
        F.when(
            text.rlike(word_pattern(names)),
            F.struct(
                F.lit(agency).alias("agency"),
                F.regexp_extract(text, word_pattern(names), 0).alias("matched"),
            ),
        )
        for agency, names in AGENCIES
    ]
    return F.when(text.rlike(ANY_AGENCY), F.coalesce(*hits))


def with_wire(
    df: DataFrame,
    *,
    byline: Column,
    body: Column,
    head: Column | None = None,
    skip: Column | None = None,
) -> DataFrame:
    """Add ``wire_agency``, ``wire_evidence`` and ``wire_matched``, strongest evidence first.

    ``skip`` marks rows that cannot be syndicated (regulators, exchanges).
    """
    skipped = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)

    def shown(text: Column) -> Column:
        return F.when(~skipped, text)

    return add_steps(
        df,
        _wire_stages(),
        {
            "byline": shown(byline),
            "head_in": shown(head) if head is not None else F.lit(None).cast("string"),
            "body": shown(body),
        },
        {"agency": "wire_agency", "evidence": "wire_evidence", "matched": "wire_matched"},
    )


@lru_cache
def _wire_stages() -> tuple[Stage, ...]:
    def hit(found: Column, evidence: Column | str) -> Column:
        kind = F.lit(evidence) if isinstance(evidence, str) else evidence
        return F.when(
            found.isNotNull(),
            F.struct(
                found["agency"].alias("agency"), kind.alias("evidence"), found["matched"].alias("matched")
            ),
        )

    return (
        {
            "head": lambda g: F.left(F.coalesce(g("head_in"), g("body")), F.lit(HEAD_CHARS)),
            "in_byline": lambda g: F.coalesce(
                _find_agency(g("byline")),
                F.when(
                    g("byline").rlike(r"(?i)^\s*AP\s*$"),
                    F.struct(F.lit("AP").alias("agency"), web_trim(g("byline")).alias("matched")),
                ),
            ),
        },
        {
            "in_dateline": lambda g: F.when(
                g("in_byline").isNull() & g("head").rlike(DATELINE),
                _find_agency(F.regexp_extract(g("head"), DATELINE, 1)),
            ),
        },
        {
            "in_head": lambda g: F.when(
                g("in_byline").isNull() & g("in_dateline").isNull(), _find_agency(g("head"))
            ),
        },
        {
            "lead": lambda g: F.left(
                g("head"), F.instr(F.lower(g("head")), F.lower(g("in_head")["matched"])) - 1
            ),
            "in_body": lambda g: F.when(
                g("in_byline").isNull() & g("in_dateline").isNull() & g("in_head").isNull(),
                _find_agency(g("body")),
            ),
        },
        {
            "wire": lambda g: F.coalesce(
                hit(g("in_byline"), "byline"),
                hit(g("in_dateline"), "dateline"),
                hit(
                    g("in_head"),
                    F.when(g("lead").rlike(BYLINE_LEAD), F.lit("byline")).otherwise(F.lit("dateline")),
                ),
                hit(g("in_body"), "mention"),
            )
        },
        {
            "agency": lambda g: g("wire")["agency"],
            "evidence": lambda g: g("wire")["evidence"],
            "matched": lambda g: g("wire")["matched"],
        },
    )


def has_verbatim_quote(quotes: Column, min_chars: int = VERBATIM_MIN_CHARS) -> Column:
    """Whether any quoted passage is long enough to be a reproduced release."""
    return F.coalesce(
        F.exists(quotes, lambda q: F.coalesce(F.char_length(web_trim(q)), F.lit(0)) >= min_chars),
        F.lit(False),
    )
