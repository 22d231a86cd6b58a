"""Typed rows from landed payloads.

The catalog says how a dataset's payload becomes rows and which of their fields later steps read.  One projection turns the rows'
VARIANT values into typed columns; fields that the catalog does not name stay readable in ``leftover``; a value that does not fit its
type leaves a null and a line in the quarantine.  All of it is one narrow pass over the payloads, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.collections import with_once
from tickerloom.sources import landed as rules
from tickerloom.sources.catalog import BY_NAME, FIELDS, Field

_RULES = {
    "rows": rules.list_rows, "lenient_rows": rules.lenient_rows, "strict_rows": rules.strict_rows, "singleton": rules.singleton_row,
    "historical": rules.historical_rows, "untouched": rules.lenient_rows,
}


class Typed(NamedTuple):
    rows: DataFrame  # keep…, pos, the catalog's columns, leftover
    cells: DataFrame  # keep…, pos, field, wanted, found: values that do not fit
    payloads: DataFrame  # keep…, error: payloads that give no rows


def fetched(landed: DataFrame) -> DataFrame:
    """Payloads of successful requests; the others have nothing to read."""
    return landed.where(rules.fetch_class(F.col("http_status")) == "ok")


def _quoted(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _raw(field: Field) -> Column:
    return F.try_variant_get("row", _quoted(field.vendor), "variant")


def _value(field: Field) -> Column:
    """The field in its type; text becomes a date or a number only if all of it is one."""
    return F.try_variant_get("row", _quoted(field.vendor), field.kind)


def _cell(field: Field) -> Column:
    raw = _raw(field)
    found = raw.isNotNull() & ~F.is_variant_null(raw)
    return F.struct(
        F.lit(field.vendor).alias("field"), F.lit(field.kind).alias("wanted"),
        F.when(found & F.col(f"_{field.column}").isNull(), F.to_json(raw)).alias("found"),
    )


def typed_rows(landed: DataFrame, *datasets: str, keep: Sequence[str] = ("symbol",)) -> Typed:
    """Typed rows of one dataset, or of several with the same shape and fields.

    ``landed`` has dataset, http_status, payload and the columns to ``keep`` (which may share names with fields: the payload's win
    unless they are kept).  ``pos`` is the row's place in its payload.
    """
    spec, fields = BY_NAME[datasets[0]], FIELDS[datasets[0]]
    if any(BY_NAME[d].shape != spec.shape or FIELDS[d] != fields for d in datasets):
        raise ValueError("datasets differ in shape or fields")
    fields = tuple(f for f in fields if f.column not in keep)
    normalized = _RULES[spec.shape](fetched(landed.where(F.col("dataset").isin(*datasets))))
    exploded = rules.explode_rows(normalized, *keep).withColumnRenamed("ord", "pos")
    valued = with_once(exploded, **{f"_{f.column}": _value(f) for f in fields})
    # Only fields without a column become JSON, and the text of every value of theirs.
    other = F.map_filter(F.try_variant_get("row", "$", "map<string,variant>"), lambda k, _: ~k.isin(*[f.vendor for f in fields]))
    rows = valued.select(
        *keep, "pos", *[F.col(f"_{f.column}").alias(f.column) for f in fields],
        F.from_json(F.to_json(other), "map<string,string>").alias("leftover"),
    )
    cells = valued.select(*keep, "pos", F.inline(F.array(*[_cell(f) for f in fields]))).where("found IS NOT NULL")
    return Typed(rows, cells, rules.error_table(normalized, *keep))
