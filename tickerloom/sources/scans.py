"""Typed scans over the silver tables.

Filters stay plain comparisons on the stored columns so that they reach the
Parquet scan (and prune partitions when a table is partitioned by them); row
limits per key are ranking windows, which Spark turns into a group limit that
drops surplus rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalars import normalize_symbol

PERIODS = ("annual", "quarter")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank"
                    ) -> DataFrame:
    """At most ``limit`` rows per key in the given order, with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, wide columns and all.

    Keys and order are aggregated alone, in hash tables; the wide rows are then
    filtered by a semi join, which needs no exchange of them while the newest
    keys fit a broadcast (checked by size at run time).  Of rows that tie, the one
    with the smallest hash stays; rows without ``order`` only where a key has no other.
    """
    newest = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(order).alias("_newest"))
    same = F.col(order).eqNullSafe(F.col("_newest"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # Maps and VARIANT values have no hash of their own; their JSON has.
    hashed = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in df.dtypes]
    picked = df.join(newest, same, "left_semi").withColumn("_tie", F.xxhash64(*hashed))
    return first_per_group(picked, keys, [F.col("_tie")], 1, "_rank").drop("_tie", "_rank")


def _between(rows: DataFrame, lo: Column, hi: Column) -> Column:
    """Rows of an inclusive date range; tables partitioned by ``month`` read the range's months only."""
    inside = F.col("date").between(lo, hi)
    if "month" not in rows.columns:
        return inside
    return inside & F.col("month").between(*(F.year(d) * 100 + F.month(d) for d in (lo, hi)))


def calendar_between(calendar: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Calendar rows of an inclusive date range."""
    return calendar.where(_between(calendar, F.lit(start).cast("date"), F.lit(end).cast("date")))


def for_symbols(rows: DataFrame, requested: DataFrame, *, order: Sequence[Column] = (), limit: int | None = None
                ) -> DataFrame:
    """Rows of the requested symbols, optionally the first ``limit`` of each.

    Requested symbols are trimmed and upper-cased, blanks are dropped.  The
    join strategy is left to the optimizer, which broadcasts the request list
    only when its measured size allows it.
    """
    wanted = requested.select(normalize_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null").distinct()
    hits = rows.join(wanted, "symbol", "left_semi")
    return hits if limit is None else first_per_group(hits, ["symbol"], order, limit)


def period_table(rows: DataFrame, period: str, limit: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Newest ``limit`` statements per key for one reporting period."""
    if period not in PERIODS:
        raise ValueError("period must be 'annual' or 'quarter'")
    picked = rows.where((F.col("period") == period) & F.col("symbol").isNotNull())
    return first_per_group(picked, keys, [F.col("date").desc(), F.col("ord")], limit)


def window_page(rows: DataFrame, start: date | str | Column, end: date | str, *, page: int = 0, limit: int = 40) -> DataFrame:
    """One page of each symbol's rows in an inclusive date range, newest first."""
    lo = start if isinstance(start, Column) else F.lit(start)
    inside = rows.where(_between(rows, lo.cast("date"), F.lit(end).cast("date")))
    upto = first_per_group(inside, ["symbol"], [F.col("date").desc(), F.col("ord")], (page + 1) * limit)
    return upto.where(F.col("rank") > page * limit)


def day_snapshot(rows: DataFrame, as_of: date | str) -> DataFrame:
    """The cross-section of one day."""
    return rows.where(F.col("date") == F.lit(as_of).cast("date"))


def batch_lookup(rows: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Rows for a caller's literal symbol list; an empty list gives no rows."""
    wanted = sorted({s.strip().upper() for s in symbols if s and s.strip()})
    return rows.where(F.col("symbol").isin(wanted)) if wanted else rows.where(F.lit(False))


def named_series(rows: DataFrame, level: str, name: str) -> DataFrame:
    """One named time series; a blank name is refused."""
    label = name.strip()
    if not label:
        raise ValueError("series name must be non-empty")
    return rows.where((F.col("level") == level) & (F.col("name") == label))


def stored_metrics(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Attach the stored metrics text of each (symbol, date); absent ones stay null."""
    right = metrics.select("symbol", F.col("date").alias("metrics_date"), "metrics_json")
    return requests.join(right, ["symbol", "metrics_date"], "left")
