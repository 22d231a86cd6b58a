"""Idempotent table sinks: one row per (date, symbol), rewriting replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom.session import materialize
from tickerloom.sources.scans import latest_rows

KEYS = ("date", "symbol")


def latest_per_key(rows: DataFrame, order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last write of each key wins within one batch."""
    return latest_rows(rows, keys, order).select(*keys, *[c for c in rows.columns if c not in keys])


def merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contents of the touched dates after the upsert; ``existing`` holds these dates only."""
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def replace_dates(rows: DataFrame, path: str) -> None:
    """Write whole dates; only dates present in ``rows`` are replaced.

    The rebalance hint gathers a date's rows for few files per folder and,
    with AQE, splits a date that is much larger than the others.
    """
    (
        rows.hint("rebalance", "date").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


#: Dates that one upsert may touch: they are listed to prune the stored table.
MOST_DATES = 20_000


def upsert(rows: DataFrame, path: str, *, order: str | None = None, keys: Sequence[str] = KEYS) -> None:
    """Insert or replace by (date, symbol) in a date-partitioned Parquet table.

    Untouched dates are neither read nor rewritten.  Without ``order`` a
    repeated key is refused.  The touched dates are first written whole beside
    the table; a call that finds such a folder complete finishes the replacement
    that was broken off, so a failure at any point loses no kept row and
    repeating the call gives the same table.
    """
    spark = rows.sparkSession
    pending = f"{path.rstrip('/')}__pending"
    finish_pending(spark, pending, path)
    # Written once: the rows are read for their dates, their keys and the merge.
    # The last of each key reads its rows twice, which must number them alike (an order of arrival is not computed twice).
    incoming = materialize(rows, "upsert")
    if order:
        incoming = materialize(latest_per_key(incoming, order, keys).drop(order), "upsert")
    if not order and not incoming.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("rows repeat a key; give the column that orders them")
    existing = read_if_present(spark, path, incoming.schema)
    if existing is not None:
        dates = [r["date"] for r in incoming.select("date").distinct().limit(MOST_DATES + 1).collect()]
        if len(dates) > MOST_DATES:
            raise ValueError(f"more than {MOST_DATES} dates in one upsert; split it by date")
        incoming = merged(touched_dates(existing, dates), incoming, keys)
    incoming.write.mode("overwrite").parquet(pending)
    finish_pending(spark, pending, path)


def touched_dates(existing: DataFrame, dates: Sequence) -> DataFrame:
    """The stored rows of the given dates; the filter prunes the table's folders."""
    known = existing.where(F.col("date").isin([d for d in dates if d is not None]))
    return known.unionByName(existing.where("date IS NULL")) if None in dates else known


def finish_pending(spark: SparkSession, pending: str, path: str) -> None:
    """Carry out a replacement whose rows were completely written, then remove them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(pending)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{pending}/_SUCCESS")):
        replace_dates(spark.read.parquet(pending), path)
        files.delete(folder, True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a later table replaces; one that is gone already is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at ``path`` read with a given schema, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def json_lines(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row as JSON text: null fields kept, dates as ISO text, non-ASCII as is."""
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}
    return rows.select(F.to_json(F.struct("*"), options).alias(column))
