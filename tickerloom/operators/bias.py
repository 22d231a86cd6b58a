"""Bias detection over deviation history, corrections and their versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.ordered import next_value, running_total


def analyze(
    history: DataFrame,
    by: Sequence[str] = (),
    *,
    min_samples: int = fv.MIN_SAMPLES,
    rate_limit: float = fv.FAILURE_RATE_LIMIT,
) -> DataFrame:
    """Failure statistics of the valid samples, overall or per ``by`` columns.

    A sample is valid when ``within_threshold`` is known.  Below
    ``min_samples`` all failure figures are zeroed and the reason is set.
    """
    miss = F.col("within_threshold") == F.lit(False)
    miss_deviation = F.when(miss, F.coalesce("deviation", F.lit(0.0)))
    stats = history.groupBy(*by).agg(
        F.count("*").alias("history_rows"),
        F.count("within_threshold").alias("total_samples"),
        F.count_if(miss).alias("failures"),
        F.avg(F.abs(miss_deviation)).alias("mean_abs"),
        F.avg(miss_deviation).alias("mean_signed"),
    )
    enough = F.col("total_samples") >= min_samples
    rate = F.when(enough, F.col("failures") / F.col("total_samples")).otherwise(F.lit(0.0))
    return stats.select(
        *by,
        "history_rows",
        "total_samples",
        F.when(enough, F.col("failures")).otherwise(F.lit(0)).cast("long").alias("failure_count"),
        rate.alias("failure_rate"),
        F.when(enough, F.coalesce("mean_abs", F.lit(0.0))).alias("avg_deviation"),
        F.when(enough, F.coalesce("mean_signed", F.lit(0.0))).alias("avg_signed_deviation"),
        F.when(enough, F.when(F.col("mean_signed") > 0, "overestimate").otherwise("underestimate"))
        .alias("bias_direction"),
        (enough & (rate > rate_limit)).alias("needs_correction"),
        F.when(~enough, F.lit("insufficient_samples")).alias("analysis_reason"),
    )


def decide(analysis: DataFrame) -> DataFrame:
    """Adds action and reason; the analysis' own reason wins over the generic one."""
    action = F.when(F.col("needs_correction"), "corrected").otherwise("skip")
    reason = (
        F.when(F.col("history_rows") == 0, "no_history")
        .when(F.col("analysis_reason").isNotNull(), F.col("analysis_reason"))
        .when(~F.col("needs_correction"), "within_threshold")
    )
    return analysis.withColumn("action", action).withColumn("reason", reason)


def _percent(name: str, digits: int) -> Column:
    """Share as a percentage; ties go to the even digit before the text is formatted."""
    return F.bround(F.col(name) * 100, digits)


def recommendation_text() -> Column:
    return F.format_string(
        fv.RECOMMENDATION_FORMAT,
        F.col("bias_direction"),
        _percent("avg_deviation", 2),
        _percent("failure_rate", 1),
        F.col("failure_count"),
        F.col("total_samples"),
    )


def correction_events(decisions: DataFrame, at: Column) -> DataFrame:
    """One event per decision that asks for a correction."""
    return decisions.where("action = 'corrected'").select(
        at.alias("timestamp"),
        F.lit(fv.CORRECTION_TRIGGER).alias("trigger"),
        "failure_rate",
        "bias_direction",
        "avg_deviation",
        recommendation_text().alias("recommendation"),
    )


def corrected_content(content: Column, event: str = "event") -> Column:
    """Prompt text with the correction block of the struct column ``event`` appended."""
    e = lambda name: F.col(f"{event}.{name}")
    block = F.format_string(
        fv.CORRECTION_BLOCK_FORMAT,
        e("timestamp"),
        e("trigger"),
        e("bias_direction"),
        e("recommendation"),
        e("bias_direction"),
        _percent(f"{event}.failure_rate", 0),
    )
    return F.concat(content, block)


def current_versions(versions: DataFrame) -> DataFrame:
    """Latest text per prompt of an append-only (prompt, version_ts, content) table."""
    return versions.groupBy("prompt").agg(
        F.max_by("content", "version_ts").alias("content"), F.max("version_ts").alias("version_ts")
    )


def apply_corrections(versions: DataFrame, events: DataFrame) -> DataFrame:
    """New version rows: the current text of every prompt plus each event's block.

    Nothing is rewritten; the caller appends the result to the version table,
    whose older rows are the archive.  ``events`` holds one row at most (a
    scalar subquery refuses more); without one there is nothing to add.
    """
    event = events.select(F.struct("*").alias("event")).scalar()
    corrected = current_versions(versions).withColumn("event", event).where("event is not null")
    return corrected.select(
        "prompt",
        F.col("event.timestamp").cast("timestamp").alias("version_ts"),
        corrected_content(F.col("content")).alias("content"),
    )


def version_ranges(versions: DataFrame) -> DataFrame:
    """Validity ranges: a version ends where the next one of its prompt begins."""
    ranged = next_value(versions, ["prompt"], ["version_ts"], "version_ts", F.trunc("version_ts", "month"), "valid_to")
    return ranged.withColumnRenamed("version_ts", "valid_from").withColumn("is_current", F.col("valid_to").isNull())


def miss_streaks(history: DataFrame, min_length: int = fv.STREAK_LENGTH) -> DataFrame:
    """Runs of at least ``min_length`` consecutive misses per symbol.

    Misses between the same two hits share the running number of hits, so the
    run is a plain group-by once that number is known.  Rows of one day stand
    in the order in which they were appended (evaluation date, where the history
    has it); what still ties stands misses first, then by deviation.
    """
    appended = [c for c in ("evaluation_date",) if c in history.columns]
    samples = history.where("within_threshold is not null").select("symbol", "date", *appended, "within_threshold", "deviation")
    numbered = running_total(
        samples, ["symbol"], ["date", *appended, "within_threshold", "deviation"], F.col("within_threshold").cast("long"), F.trunc("date", "quarter"), "hits_before"
    )
    return (
        numbered.where("not within_threshold")
        .groupBy("symbol", "hits_before")
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.count("*").alias("streak"),
            F.avg("deviation").alias("mean_deviation"),
        )
        .where(F.col("streak") >= min_length)
        .drop("hits_before")
    )


def meta_review(
    history: DataFrame,
    by: Sequence[str] = (),
    *,
    min_samples: int = fv.MIN_SAMPLES,
    no_action_rate: float = fv.NO_ACTION_PASS_RATE,
) -> DataFrame:
    """Pass rate, direction, magnitude, consistency and the advised action."""
    signed = F.col("deviation")
    stats = history.where("within_threshold is not null").groupBy(*by).agg(
        F.count("*").alias("total_samples"),
        F.count_if("within_threshold").alias("pass_count"),
        F.avg(F.abs(signed)).alias("mean_abs"),
        F.avg(signed).alias("mean_signed"),
        F.count_if(signed > 0).alias("over"),
        F.count_if(signed < 0).alias("under"),
    )
    total = F.col("total_samples")
    pass_rate = F.when(total > 0, F.col("pass_count") / total).otherwise(F.lit(0.0))
    same_side = F.greatest("over", "under")
    mean_signed = F.round(F.coalesce("mean_signed", F.lit(0.0)), 4)
    action = (
        F.when(pass_rate > no_action_rate, "no_action")
        .when(same_side >= min_samples, "correct")
        .otherwise("monitor")
    )
    return stats.select(
        *by,
        "total_samples",
        "pass_count",
        (total - F.col("pass_count")).alias("fail_count"),
        F.round(pass_rate, 4).alias("pass_rate"),
        F.round(F.coalesce("mean_abs", F.lit(0.0)), 4).alias("avg_deviation"),
        F.when(mean_signed > 0, "overestimate").when(mean_signed < 0, "underestimate").otherwise("neutral")
        .alias("direction"),
        F.abs(mean_signed).alias("magnitude"),
        F.round(F.when(total > 0, same_side / total).otherwise(F.lit(0.0)), 4).alias("consistency"),
        action.alias("action"),
    )


def bias_by_factor(history: DataFrame, profile: DataFrame, factor: str = "sector") -> DataFrame:
    """Deviation per factor value plus the grand total (``is_total``)."""
    samples = history.where("within_threshold is not null").join(profile.select("symbol", factor), "symbol", "left")
    return (
        samples.groupingSets([[F.col(factor)], []], F.col(factor))
        .agg(
            F.grouping(factor).alias("is_total"),
            F.count("*").alias("samples"),
            F.count_if(~F.col("within_threshold")).alias("misses"),
            F.avg("deviation").alias("mean_deviation"),
        )
    )
