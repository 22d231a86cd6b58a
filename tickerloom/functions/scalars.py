"""Scalar clean-up rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space (plain ``trim`` handles spaces only)."""
    return F.btrim(c, F.lit(fv.WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_symbol(c: Column) -> Column:
    """Trim and upper-case; blank becomes null (an invalid symbol)."""
    return blank_to_null(F.upper(strip(c)))


def normalize_cik(c: Column) -> Column:
    """Null-like text to null, digits padded to ten places and never cut."""
    return padded_cik(strip(c))


def padded_cik(text: Column) -> Column:
    """The CIK rule for text that is trimmed already."""
    digits = text.rlike("^[0-9]+$") & (F.length(text) < 10)
    return (
        F.when(text.isNull() | F.lower(text).isin("", "none", "null"), None)
        .when(digits, F.lpad(text, 10, "0"))
        .otherwise(text)
    )


def iso_day(c: Column) -> Column:
    """Date or timestamp to ``yyyy-MM-dd`` text; the time part is dropped."""
    return F.date_format(c.cast("date"), "yyyy-MM-dd")


def parse_iso_date(c: Column) -> Column:
    """Tolerant date parse: extended or compact ISO form, invalid to null."""
    text = strip(c)
    head = F.substring(text, 1, 10)
    return F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")),
        F.when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")),
    )


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor the empty string (no trimming)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def first_nonblank(*cols: Column) -> Column:
    """First value with visible text, trimmed."""
    return F.coalesce(*[blank_to_null(strip(c)) for c in cols])


def clean_label(primary: Column, fallback: Column) -> Column:
    """Sector / industry name: choose first, trim afterwards.

    A primary value made of spaces wins over the fallback and then becomes
    null; the order of the two steps is part of the contract.
    """
    return blank_to_null(strip(first_truthy(primary, fallback)))


def shorten(c: Column, width: int = 80) -> Column:
    """Texts over ``width`` characters keep ``width - 3`` of them plus dots."""
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def truncate_with_note(c: Column, limit: int = fv.SNAPSHOT_MAX_CHARS) -> Column:
    note = F.format_string("\n\n[TRUNCATED — original %d chars]", F.length(c))
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), note)).otherwise(c)


def safe_slug(c: Column) -> Column:
    return F.regexp_replace(c, fv.UNSAFE_SLUG_CHAR, "_")


def report_basename(day: Column, symbol: Column) -> Column:
    return F.concat_ws("-", day, safe_slug(symbol))
