"""The three stream jobs: discovery, gate on arrival, status changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickerloom.functions.ordered import previous_value
from tickerloom.functions.scalars import blank_to_null
from tickerloom.operators.discovery import unprocessed
from tickerloom.operators.gate import check_documents
from tickerloom.operators.sinks import remove_folder, upsert
from tickerloom.session import materialize


def discovery_stream(calendar: DataFrame, keys: DataFrame) -> DataFrame:
    """New symbols of a calendar stream that have no report yet.

    ``calendar`` is a stream with symbol and ts, ``keys`` the static listing of
    stored artifacts.  The dates are data dates and may come in any order, so
    there is no watermark: the state keeps every symbol seen, one small entry
    each, and the result is the batch's whatever the order of arrival.
    """
    named = calendar.where(blank_to_null(F.col("symbol")).isNotNull()).select("symbol", F.col("ts").cast("timestamp").alias("ts"))
    return unprocessed(named.dropDuplicates(["symbol"]), keys)


def gate_results(docs: DataFrame, order: str) -> DataFrame:
    """Gate columns that are stored per document, with the column that orders arrivals."""
    return check_documents(docs, require_critique=F.col("stage") == "final").select(
        "date", "symbol", "stage", "passed", "severity", "failures", "warnings", "metrics", F.col(order).alias("arrival"))


def gate_stream(docs: DataFrame, path: str, checkpoint: str, order: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Check documents as they land and keep one result per (date, symbol).

    ``prepare`` may complete the landed rows (joins with other tables) before
    the check.  Of a key that lands more than once in a micro-batch the row
    with the largest ``order`` stays.  The sink replaces by key, so a
    micro-batch that runs twice after a failure leaves the same table.
    """
    def store(batch: DataFrame, _epoch: int) -> None:
        upsert(gate_results(prepare(batch) if prepare else batch, order), path, order="arrival")

    return (
        docs.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


CHANGE_SCHEMA = "symbol STRING, ts TIMESTAMP, event_id LONG, previous STRING, status STRING"


def status_changes(events: DataFrame) -> DataFrame:
    """Batch form: rows whose status differs from the symbol's previous one.

    ``events`` has symbol, ts, event_id and status.  A symbol's first row is a
    change from null.
    """
    seen = previous_value(events, ["symbol"], ["ts", "event_id"], "status", F.to_date("ts"), "previous")
    changed = ~F.col("status").eqNullSafe(F.col("previous"))
    return seen.where(changed).select("symbol", "ts", "event_id", "previous", "status")


#: Micro-batches whose state tables are merged into one; a symbol's stored status is rewritten once per power of it.
MERGE_EVERY = 8


def state_tables(done: int, merge_every: int = MERGE_EVERY) -> list[tuple[int, int]]:
    """Ranges [first, end) of micro-batches whose tables hold the state after ``done`` of them.

    The ranges are the digits of ``done`` to the base ``merge_every``: few tables, each a power of the base long.  They follow
    from the number alone, so a micro-batch that runs again reads what it read the first time.
    """
    size = 1
    while size * merge_every <= done:
        size *= merge_every
    tables, start = [], 0
    while size:
        while start + size <= done:
            tables.append((start, start + size))
            start += size
        size //= merge_every
    return tables


def _state_path(state: str, table: tuple[int, int]) -> str:
    return f"{state.rstrip('/')}/batches={table[0]}-{table[1]}"


def store_status_changes(batch: DataFrame, epoch: int, path: str, state: str, merge_every: int = MERGE_EVERY) -> None:
    """One micro-batch of ``status_change_stream``: its changes below ``path``, its new statuses below ``state``.

    Only symbols whose last status differs from the stored one get a state row.  Every ``merge_every`` micro-batches the tables of
    one length become one table, the newest status of a symbol staying.  The tables that the micro-batch before merged are
    removed: it is committed once this one starts, so nothing reads them again.
    """
    new = batch.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    spark = new.sparkSession
    stored = StructType([*new.schema.fields, StructField("epoch", LongType())])
    read = lambda tables: spark.read.schema(stored).parquet(*[_state_path(state, t) for t in tables])
    newest = lambda rows: rows.groupBy("symbol").agg(F.max(F.struct("epoch", "ts", "event_id", "status")).alias("s")).select(
        "symbol", "s.ts", "s.event_id", "s.status", "s.epoch")
    tables = state_tables(epoch, merge_every)
    rows = new.withColumn("fresh", F.lit(True))
    last = newest(new.withColumn("epoch", F.lit(epoch).cast("long")))
    if tables:
        before = materialize(newest(read(tables).join(new.select("symbol").distinct(), "symbol", "left_semi")), "stored-status")
        rows = rows.unionByName(before.drop("epoch").withColumn("fresh", F.lit(False)))
        known = before.select("symbol", F.col("status").alias("known"))
        last = last.join(known, "symbol", "left").where(~F.col("status").eqNullSafe(F.col("known"))).drop("known")
    # Stored rows come first whatever their time stamp, then the batch in time order.
    bucket = F.when(F.col("fresh"), F.to_date("ts")).otherwise(F.lit("0001-01-01").cast("date"))
    seen = previous_value(rows, ["symbol"], ["fresh", "ts", "event_id"], "status", bucket, "previous")
    changed = F.col("fresh") & ~F.col("status").eqNullSafe(F.col("previous"))
    seen.where(changed).select("symbol", "ts", "event_id", "previous", "status").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    added = next(t for t in state_tables(epoch + 1, merge_every) if t not in tables)
    inside = [t for t in tables if t[0] >= added[0]]
    if inside:
        last = newest(last.unionByName(read(inside)))
    last.select(*stored.fieldNames()).write.mode("overwrite").parquet(_state_path(state, added))
    merged_before = set(state_tables(epoch - 1, merge_every)) - set(tables) if epoch else set()
    for table in merged_before:
        remove_folder(spark, _state_path(state, table))


def status_change_stream(events: DataFrame, path: str, state: str, checkpoint: str):
    """Stream form: compares new rows with the last status kept per symbol.

    The state is a few small tables that micro-batches add to (``store_status_changes``), so a micro-batch writes the statuses
    it changed and not all of them, and a repeated one gives the same files.  Within a batch the skew-proof batch operator
    runs: no symbol's rows are gathered in one task.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, epoch: store_status_changes(batch, epoch, path, state))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available now into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
