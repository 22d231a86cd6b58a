"""Forecast evaluation: as-of price lookup and deviation records.

The price of a forecast is the first close on or after its target date within
a few days.  The tolerance is a hard bound, so the as-of join becomes an equi
join on (symbol, day): each distinct (symbol, target) asks for its
``tolerance + 1`` days and keeps the earliest day that has a price.  Prices are
shuffled once, already combined per day; there is no per-symbol sort, no range
join and no collected list, so a symbol holding a third of all rows is spread
over as many keys as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.collections import once, strict_json
from tickerloom.session import last_key_wins
from tickerloom.sources.scans import stored_metrics


def target_date(metrics_date: Column, offset_days: int = fv.FORECAST_OFFSET_DAYS) -> Column:
    return F.date_add(metrics_date, offset_days)


def pick_price(close: Column, adj_close: Column) -> Column:
    """Close, unless it is null or zero; then the adjusted close."""
    return F.coalesce(F.nullif(close, F.lit(0.0)), adj_close)


def relative_deviation(predicted: Column, actual: Column) -> Column:
    return F.when(actual == 0, F.lit(0.0)).otherwise((predicted - actual) / actual)


def daily_prices(eod: DataFrame) -> DataFrame:
    """One row per (symbol, date): the first in source order."""
    dated = eod.where(F.col("date").isNotNull() & F.col("symbol").isNotNull())
    return dated.groupBy("symbol", "date").agg(
        F.min_by("close", "ord").alias("close"), F.min_by("adj_close", "ord").alias("adj_close"))


def undated_prices(eod: DataFrame) -> DataFrame:
    """Last row without a date per symbol: the fallback when no dated row qualifies."""
    undated = eod.where(F.col("date").isNull() & F.col("symbol").isNotNull())
    return undated.groupBy("symbol").agg(
        F.max_by("close", "ord").alias("undated_close"), F.max_by("adj_close", "ord").alias("undated_adj_close"),
        F.lit(True).alias("has_undated"))


def target_prices(requests: DataFrame, eod: DataFrame, tolerance: int = fv.PRICE_TOLERANCE_DAYS) -> DataFrame:
    """Earliest priced day of every distinct (symbol, target_date) that has one."""
    target = F.col("target_date")
    wanted = requests.select("symbol", "target_date").where(target.isNotNull()).distinct()
    days = wanted.withColumn("date", F.explode(F.sequence(target, F.date_add(target, tolerance))))
    return days.join(daily_prices(eod), ["symbol", "date"]).groupBy("symbol", "target_date").agg(
        F.min("date").alias("price_date"), F.min_by("close", "date").alias("close"),
        F.min_by("adj_close", "date").alias("adj_close"))


def as_of_price(requests: DataFrame, eod: DataFrame, tolerance: int = fv.PRICE_TOLERANCE_DAYS) -> DataFrame:
    """Adds price_date, close, adj_close and ``price_origin`` (dated / undated / none).

    ``requests`` needs symbol and target_date.
    """
    joined = requests.join(target_prices(requests, eod, tolerance), ["symbol", "target_date"], "left").join(
        undated_prices(eod), "symbol", "left")
    dated = F.col("price_date").isNotNull()
    origin = F.when(dated, "dated").when(F.col("has_undated"), "undated").otherwise("none")
    return (
        joined.withColumn("price_origin", origin)
        .withColumn("close", F.when(dated, F.col("close")).otherwise(F.col("undated_close")))
        .withColumn("adj_close", F.when(dated, F.col("adj_close")).otherwise(F.col("undated_adj_close")))
        .drop("undated_close", "undated_adj_close", "has_undated")
    )


def read_forecasts(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requests with the fields of their stored metrics document and a status."""
    last_key_wins(requests.sparkSession)
    text = F.col("metrics_json")
    found = stored_metrics(requests, metrics)
    body = F.when(strict_json(text), F.try_parse_json(text))
    parsed = found.withColumn("body", once(body))
    is_object = F.coalesce(F.schema_of_variant("body").startswith("OBJECT"), F.lit(False))
    status = F.when(text.isNull(), "missing_metrics").when(~is_object, "invalid_metrics")
    return (
        parsed.withColumn("metrics_error", status)
        .withColumn("predicted_price", F.try_variant_get("body", "$.predicted_price", "double"))
        .withColumn("confidence", F.try_variant_get("body", "$.confidence", "double"))
        .drop("body", "metrics_json")
    )


def evaluate(
    forecasts: DataFrame,
    eod: DataFrame,
    *,
    offset_days: int = fv.FORECAST_OFFSET_DAYS,
    tolerance: int = fv.PRICE_TOLERANCE_DAYS,
    threshold: float = fv.DEVIATION_THRESHOLD,
) -> DataFrame:
    """One deviation record per forecast; failures are rows with an error code."""
    base = forecasts if "metrics_error" in forecasts.columns else forecasts.withColumn(
        "metrics_error", F.lit(None).cast("string"))
    priced = as_of_price(base.withColumn("target_date", target_date(F.col("metrics_date"), offset_days)), eod,
                         tolerance)
    price = pick_price(F.col("close"), F.col("adj_close"))
    error = (
        F.when(F.col("metrics_error").isNotNull(), F.col("metrics_error"))
        .when(F.col("predicted_price").isNull(), "no_predicted_price")
        .when(F.col("price_origin") == "none", "no_price_rows")
        .when(price.isNull(), "no_close_price")
    )
    scored = priced.withColumn("error", error).withColumn("price", price)
    ok = F.col("error").isNull()
    deviation = F.when(ok, relative_deviation(F.col("predicted_price"), F.col("price")))
    return scored.select(
        "symbol",
        F.col("metrics_date").alias("date"),
        "target_date",
        F.when(ok, F.col("price_date")).alias("price_date"),
        F.when(ok, F.col("predicted_price")).alias("predicted_price"),
        F.when(ok, F.col("price")).alias("actual_price"),
        deviation.alias("deviation"),
        (deviation * 100).alias("deviation_pct"),
        (F.abs(deviation) <= threshold).alias("within_threshold"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        "error",
    )


def evaluate_batch(requests: DataFrame, metrics: DataFrame, eod: DataFrame, **options) -> DataFrame:
    """Stored metrics to deviation records for every (symbol, metrics_date) requested."""
    return evaluate(read_forecasts(requests, metrics), eod, **options)


def append_history(records: DataFrame, path: str, evaluation_date: str) -> None:
    """Append the records; history is never de-duplicated or rewritten."""
    (
        records.withColumn("evaluation_date", F.lit(evaluation_date).cast("date"))
        .write.mode("append")
        .partitionBy("evaluation_date")
        .parquet(path)
    )
