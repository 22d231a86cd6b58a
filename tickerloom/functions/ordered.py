"""Order-dependent values for keys of any size.

A plain window sorts a whole key in one task.  These helpers cut each key into
buckets along the order (a month, a day): the window runs per (key, bucket),
one aggregated row per bucket carries the state over to the next bucket, and a
second window over those few bucket rows joins the carry back.  Results equal
the single window's exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """``lag(value)`` per key in ``order``; values must be non-null."""
    tagged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    edges = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
        .drop("_last")
    )
    return (
        tagged.withColumn("_near", F.lag(value).over(inner))
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_bucket")
    )


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """``lead(value)`` per key in ``order``; values must be non-null."""
    tagged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    edges = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.min_by(value, F.struct(*order)).alias("_first"))
        .withColumn("_carry", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")))
        .drop("_first")
    )
    return (
        tagged.withColumn("_near", F.lead(value).over(inner))
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_bucket")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, bucket: Column, out: str
) -> DataFrame:
    """Cumulative sum of ``amount`` per key in ``order`` (rows up to and including this one)."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.sum("_amount").alias("_sum"))
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    return (
        tagged.withColumn("_near", F.sum("_amount").over(inner))
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn(out, F.col("_near") + F.col("_carry"))
        .drop("_near", "_carry", "_bucket", "_amount")
    )
