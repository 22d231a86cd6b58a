"""Text measures used by the document rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv


def hits(c: Column, pattern: str) -> Column:
    """Number of non-overlapping occurrences of ``pattern``."""
    return F.regexp_count(c, F.lit(pattern))


def find_all(c: Column, pattern: str) -> Column:
    """Every occurrence (whole match), in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def urls(c: Column) -> Column:
    return find_all(c, fv.URL)


def url_count(c: Column) -> Column:
    return hits(c, fv.URL)


def language_tags(c: Column) -> Column:
    """Half-width tags first, then full-width ones."""
    return F.concat(find_all(c, fv.HALF_WIDTH_TAG), find_all(c, fv.FULL_WIDTH_TAG))


def matching_lines(c: Column, pattern: str) -> Column:
    """Count of lines holding at least one match (occurrences on a line count once)."""
    return F.size(F.filter(F.split(c, "\n"), lambda line: F.rlike(line, F.lit(pattern))))


def missing_phrase_count(c: Column) -> Column:
    """Occurrences of the phrases for missing information.

    The look-ahead holds the first letters of the listed phrases, so the engine
    skips every other position instead of trying each phrase there.
    """
    flags, phrases = re.fullmatch(r"(\(\?\w+\))?(.*)", fv.MISSING_PHRASE).groups()
    first = "|".join(sorted({re.escape(p[0]) for p in phrases.split("|")}))
    return hits(c, f"{flags or ''}(?={first})(?:{phrases})")
