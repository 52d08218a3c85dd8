"""Limits on what one page, pull or payload may contribute; none unless a caller sets them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Each field is the most that is kept; None keeps all."""

    links_per_page: int | None = None
    pages_per_pull: int | None = None
    bylines: int | None = None
    byline_chars: int | None = None
    page_images: int | None = None
    summary_chars: int | None = None
    snapshot_chars: int | None = None


NO_LIMITS = Limits()
# The limits of a polite poller that reads a few pages at a time.
POLLER_LIMITS = Limits(
    links_per_page=200,
    pages_per_pull=25,
    bylines=4,
    byline_chars=200,
    page_images=12,
    summary_chars=2_000,
    snapshot_chars=500_000,
)


def left_chars(text: Column, most: int | None) -> Column:
    return text if most is None else F.left(text, F.lit(most))
