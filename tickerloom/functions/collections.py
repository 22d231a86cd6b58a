"""Array and VARIANT helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def tail(c: Column, n: int) -> Column:
    """Last ``n`` elements; shorter arrays come back whole, ``n <= 0`` gives none.

    ``slice`` with a negative start yields nothing when the array is shorter
    than the window, hence the explicit start position.
    """
    if n <= 0:
        return F.slice(c, 1, 0)
    return F.slice(c, F.greatest(F.size(c) - F.lit(n), F.lit(0)) + 1, F.lit(n))


def variant_populated_sql(name: str) -> str:
    """SQL test: not null, not JSON null, not an empty list and not an empty object."""
    return f"coalesce({name} IS NOT NULL AND NOT is_variant_null({name}) AND to_json({name}) NOT IN ('[]', '{{}}'), false)"


def variant_truthy_sql(name: str) -> str:
    """SQL test: what a dynamic language calls truthy, so also false for 0, "" and false."""
    empty = """'null', '[]', '{}', '""', 'false', '0', '0.0'"""
    return f"coalesce({name} IS NOT NULL AND to_json({name}) NOT IN ({empty}), false)"


def array_populated_sql(name: str) -> str:
    """SQL test: a non-null array or map with at least one element."""
    return f"coalesce(size({name}) > 0, false)"


def variant_populated(name: str) -> Column:
    return F.expr(variant_populated_sql(name))


def strict_json(c: Column) -> Column:
    """True only if the whole text is exactly one JSON value.

    The JSON readers accept trailing garbage; wrapping the text as an array
    and counting one element rejects it.  A text that closes the array itself
    (``{}] x``) counts one element whatever follows, so a second element behind
    the text has to be seen, too.
    """
    def elements(*parts: str) -> Column:
        return F.json_array_length(F.concat(F.lit("["), c, F.lit("".join(parts))))

    return F.coalesce((elements("]") == 1) & (elements(",0]") == 2), F.lit(False))


def looks_like_object(c: Column) -> Column:
    """The first character after JSON's blanks opens an object."""
    return F.coalesce(c.rlike(r"^[ \t\n\r]*\{"), F.lit(False))


def once(c: Column) -> Column:
    """Evaluate an expensive expression exactly once per row.

    As a one-element explode it stays a separate step of the plan: filters and
    later columns refer to its result, and the optimizer cannot copy the
    expression into each of them.
    """
    return F.explode(F.array(c))


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add several columns, each evaluated exactly once per row (see ``once``)."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
