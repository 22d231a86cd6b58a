"""Landed vendor payloads to rows, with a quarantine for the bad ones.

All rules work on VARIANT, so a payload is parsed once and no vendor schema
has to be known.  Each function is one narrow pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.collections import once, strict_json, with_once
from tickerloom.session import last_key_wins


def _parsed(c: Column) -> Column:
    return F.when(strict_json(c), F.try_parse_json(c))


def _kind(v: Column, text: Column) -> Column:
    # The text's first character tells the shape of its value; the schema of a long list would be merged from all its elements.
    return (
        F.when(v.isNull(), "missing")
        .when(F.is_variant_null(v), "null")
        .when(text.rlike(r"^[ \t\n\r]*\["), "list")
        .when(text.rlike(r"^[ \t\n\r]*\{"), "object")
        .otherwise("scalar")
    )


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _all_objects(items: Column) -> Column:
    return F.forall(items, _is_object)


def _truthy_text(path: str) -> Column:
    """Text of a field of an object body when the field is truthy, else null."""
    field = F.try_variant_get(F.col("body"), path, "variant")
    falsy = F.to_json(field).isin("null", "[]", "{}", '""', "false", "0", "0.0")
    return F.when(_is_object(F.col("body")) & ~falsy, F.coalesce(
        F.try_variant_get(F.col("body"), path, "string"), F.to_json(field)))


def parse_payloads(landed: DataFrame) -> DataFrame:
    """Parse ``payload`` once: adds ``body``, ``kind`` and ``parse_error``.

    A payload is refused when it is not JSON or when it is an object whose
    error field is truthy.
    """
    last_key_wins(landed.sparkSession)
    parsed = landed.withColumn("body", once(_parsed(F.col("payload"))))
    vendor_error = F.coalesce(*[_truthy_text(path) for path in ("$['Error Message']", "$.error")])
    error = F.when(F.col("payload").isNotNull() & F.col("body").isNull(), F.lit("invalid_json")).when(
        vendor_error.isNotNull(), F.concat(F.lit("vendor_error: "), vendor_error)
    )
    # Both are read by every rule; copied into each use they would be worked out again.
    return with_once(parsed, kind=_kind(F.col("body"), F.col("payload")), parse_error=error)


def split_vendor_errors(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) payloads; both carry the parsed columns."""
    parsed = parse_payloads(landed)
    return parsed.where("parse_error is null"), parsed.where("parse_error is not null")


def list_rows(landed: DataFrame) -> DataFrame:
    """Strict row rule: adds ``rows`` (array of VARIANT) and ``row_error``.

    Null gives no rows, an object is one row, a list must hold objects only
    and anything else is an error.
    """
    parsed = parse_payloads(landed)
    items = _elements(F.col("body"))
    bad_list = (F.col("kind") == "list") & ~_all_objects(items)
    error = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(bad_list, F.lit("non_object_entries"))
        .when(F.col("kind") == "scalar", F.lit("unexpected_type"))
    )
    rows = F.when(F.col("kind") == "object", F.array(F.col("body"))).when(F.col("kind") == "list", items)
    return _with_rows(parsed, error, rows)


def historical_rows(landed: DataFrame) -> DataFrame:
    """Price rule: a bare list or an object wrapping ``historical``; otherwise an error."""
    parsed = parse_payloads(landed)
    wrapped = F.try_variant_get(F.col("body"), "$.historical", "array<variant>")
    items = F.when(F.col("kind") == "list", _elements(F.col("body"))).when(F.col("kind") == "object", wrapped)
    error = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(items.isNull(), F.lit("unexpected_shape"))
        .when(~_all_objects(items), F.lit("non_object_entries"))
    )
    return _with_rows(parsed, error, items)


def lenient_rows(landed: DataFrame) -> DataFrame:
    """Forgiving rule: list as it is, object as one row, everything else nothing."""
    parsed = parse_payloads(landed)
    rows = F.when(F.col("kind") == "object", F.array(F.col("body"))).when(
        F.col("kind") == "list", _elements(F.col("body"))
    )
    return _with_rows(parsed, F.col("parse_error"), rows)


def strict_rows(landed: DataFrame) -> DataFrame:
    """Calendar rule: a list as it is; everything else, no payload included, is an error."""
    parsed = parse_payloads(landed)
    error = F.coalesce("parse_error", F.when(F.col("kind") != "list", F.lit("unexpected_type")))
    return _with_rows(parsed, error, F.when(F.col("kind") == "list", _elements(F.col("body"))))


def singleton_row(landed: DataFrame) -> DataFrame:
    """Profile rule: an object, or the first element of a list; an empty list and everything else is an error."""
    parsed = parse_payloads(landed)
    items = F.when(F.col("kind") == "list", F.slice(_elements(F.col("body")), 1, 1))
    error = F.coalesce(
        F.col("parse_error"),
        F.when(F.size(items) == 0, F.lit("no_rows")),
        F.when(~F.col("kind").isin("list", "object"), F.lit("unexpected_type")),
    )
    return _with_rows(parsed, error, F.coalesce(items, F.when(F.col("kind") == "object", F.array(F.col("body")))))


def _with_rows(parsed: DataFrame, error: Column, rows: Column) -> DataFrame:
    none = F.array().cast("array<variant>")
    keep = F.when(F.col("row_error").isNull(), F.coalesce(rows, none)).otherwise(none)
    return parsed.withColumn("row_error", once(error)).withColumn("rows", keep)


def explode_rows(normalized: DataFrame, *keep: str) -> DataFrame:
    """One row per payload element with its position ``ord``."""
    good = normalized.where("row_error is null")
    return good.select(*keep, F.posexplode("rows").alias("ord", "row"))


def error_table(normalized: DataFrame, *keep: str) -> DataFrame:
    return normalized.where("row_error is not null").select(*keep, F.col("row_error").alias("error"))


def fetch_class(status: Column) -> Column:
    """ok / retryable / fatal by HTTP status; no response counts as retryable."""
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "retryable")
        .when(status >= 400, "fatal")
        .otherwise("ok")
    )


def fetch_summary(log: DataFrame) -> DataFrame:
    """Requests per dataset and outcome class."""
    return (
        log.withColumn("class", fetch_class(F.col("http_status")))
        .groupBy("dataset", "class")
        .agg(F.count("*").alias("n"))
    )
