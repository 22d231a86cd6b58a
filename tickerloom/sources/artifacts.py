"""Stored artifacts: key listing and whole-document reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv


def _files(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """The files whose keys start with ``prefix``: only folders and names that match are listed."""
    if any(c in prefix for c in "*?[]{}\\"):
        raise ValueError("a prefix has no wildcards")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{prefix}*")
    # Schemes are written in several ways; the key is what follows the root's own path.
    path = re.sub("^[a-z]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    return files.withColumn("key", F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), path, -1))


def list_artifacts(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Keys below ``root`` that start with ``prefix``; only file metadata is read, never the content."""
    return _files(spark, root, prefix).select("key", "length", "modificationTime")


def parse_report_keys(keys: DataFrame) -> DataFrame:
    """(date, symbol, key) of canonical report keys; everything else is ignored."""
    return (
        keys.where(F.col("key").rlike(fv.REPORT_KEY))
        .withColumn("date", F.regexp_extract("key", fv.REPORT_KEY, 1))
        .withColumn("symbol", F.regexp_extract("key", fv.REPORT_KEY, 2))
    )


def decode_utf8(c: Column) -> Column:
    """Bytes to text with malformed sequences replaced by U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def read_documents(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Whole documents (key, path, text) below ``root``, one row per file, with tolerant decoding."""
    return _files(spark, root, prefix).select("key", "path", decode_utf8(F.col("content")).alias("text"))


def write_documents(documents: DataFrame, root: str) -> None:
    """A text file for each (run_date, symbol): its documents in order of ``doc_id``, a line break after each."""
    day = documents.groupBy("run_date", "symbol").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    # A company's day is one object by contract; its size is bounded by the artifacts of one run.
    text = day.select("run_date", "symbol", F.array_join("docs.text", "\n").alias("text"))
    text.repartition("run_date", "symbol").write.partitionBy("run_date", "symbol").text(root)


def read_landed_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files as (dataset, symbol, http_status, payload) rows.

    The payload stays raw text so that a malformed one is data, not a failed
    read; directory-style ``dataset=…/symbol=…`` partitions prune the listing.
    """
    schema = "http_status INT, payload STRING, dataset STRING, symbol STRING"
    return spark.read.schema(schema).json(path)
