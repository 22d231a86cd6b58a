"""Stream jobs drained over whole driver tables, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.plans.discovery_queries import _PROCESSED
from tickerloom.plans.document_queries import GATE
from tickerloom.plans.registry import iso, joined, query
from tickerloom.plans.views import Views
from tickerloom.session import scratch_dir
from tickerloom.streaming import jobs


def stream_of(v: Views, table: str):
    """A driver table, one Parquet file or a folder of them, as a file stream."""
    # A stream's path must be a folder or a pattern; the braces make a pattern that only the table's own name matches.
    reader = v.spark.readStream.schema(getattr(v, table).schema).option("basePath", v.folder)
    return reader.parquet(f"{v.folder}/{{{table}.parquet}}")


def status_events(events):
    return events.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id", F.col("event_type").alias("status"))


@query("t01_discovery_stream", """
SELECT DISTINCT 'S' || CAST(user_id AS STRING) AS symbol FROM {events}
WHERE 'S' || CAST(user_id AS STRING) NOT IN (SELECT symbol FROM {c_done} WHERE symbol IS NOT NULL)""", c_done=_PROCESSED)
def t01(v):
    path, checkpoint = scratch_dir(v.spark, "discovery"), scratch_dir(v.spark, "state")
    fresh = jobs.discovery_stream(status_events(stream_of(v, "events")), v.v_stored_keys)
    jobs.run_to_table(fresh.select("symbol"), path, checkpoint)
    return v.spark.read.schema("symbol STRING").parquet(path)


GATE_SCHEMA = "symbol STRING, stage STRING, passed BOOLEAN, severity STRING, failures ARRAY<STRING>, date DATE"


@query("t02_gate_stream", """
SELECT CAST(date AS STRING) AS date, symbol, stage, passed, severity, failures FROM {c_gate}""", **GATE)
def t02(v):
    path, checkpoint = scratch_dir(v.spark, "gate"), scratch_dir(v.spark, "state")
    reports = lambda batch: Views(batch.sparkSession, v.folder, documents=batch).v_reports
    jobs.gate_stream(stream_of(v, "documents"), path, checkpoint, "doc_key", prepare=reports).awaitTermination()
    # With a schema a table without rows is read, too.
    rows = v.spark.read.schema(GATE_SCHEMA).parquet(path)
    return rows.select(iso("date"), "symbol", "stage", "passed", "severity", joined("failures", "; "))


_CHANGES = """
SELECT symbol, event_id, coalesce(previous, '') AS previous, status FROM (
  SELECT 'S' || CAST(user_id AS STRING) AS symbol, event_id, event_type AS status,
    LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}) t
WHERE previous IS NULL OR previous <> status"""


def _changes(rows):
    return rows.select("symbol", "event_id", F.coalesce("previous", F.lit("")).alias("previous"), "status")


@query("t03_status_changes", _CHANGES)
def t03(v):
    return _changes(jobs.status_changes(status_events(v.events)))


@query("t03_status_stream", _CHANGES)
def t03_stream(v):
    path, state, checkpoint = (scratch_dir(v.spark, n) for n in ("changes", "last", "state"))
    jobs.status_change_stream(status_events(stream_of(v, "events")), path, state, checkpoint).awaitTermination()
    return _changes(v.spark.read.schema(jobs.CHANGE_SCHEMA).option("recursiveFileLookup", "true").parquet(path))
