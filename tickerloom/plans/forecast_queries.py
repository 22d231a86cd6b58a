"""Forecast evaluation, bias and correction plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import bias as b
from tickerloom.operators import deviation as dev
from tickerloom.plans.registry import iso, query
from tickerloom.plans.source_queries import C_FORECASTS
from tickerloom.plans.views import Views
from tickerloom.session import materialize, scratch_dir

C_TARGET = "SELECT *, CAST(metrics_date + INTERVAL 30 DAY AS DATE) AS target FROM {c_f}"
C_DATED = """
SELECT t.symbol, t.metrics_date, p.date, p.close, p.adj_close FROM {c_target} t JOIN {v_eod} p
  ON p.symbol = t.symbol AND p.date BETWEEN t.target AND CAST(t.target + INTERVAL 5 DAY AS DATE)
QUALIFY ROW_NUMBER() OVER (PARTITION BY t.symbol, t.metrics_date ORDER BY p.date, p.ord) = 1"""
C_UNDATED = """
SELECT symbol, close, adj_close FROM {v_eod} WHERE date IS NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ord DESC) = 1"""
C_PRICED = """
SELECT t.*, d.symbol IS NOT NULL AS is_dated, u.symbol IS NOT NULL AS is_undated, d.date AS price_date,
  CASE WHEN d.symbol IS NOT NULL THEN coalesce(nullif(d.close, 0), d.adj_close)
       ELSE coalesce(nullif(u.close, 0), u.adj_close) END AS price
FROM {c_target} t LEFT JOIN {c_dated} d ON d.symbol = t.symbol AND d.metrics_date = t.metrics_date
LEFT JOIN {c_undated} u ON u.symbol = t.symbol"""
C_ERRORS = """
SELECT *, CASE WHEN metrics_error IS NOT NULL THEN metrics_error WHEN predicted_price IS NULL THEN 'no_predicted_price'
  WHEN NOT is_dated AND NOT is_undated THEN 'no_price_rows' WHEN price IS NULL THEN 'no_close_price' END AS error
FROM {c_priced}"""
C_DEV = """
SELECT symbol, metrics_date AS date, target, error, CASE WHEN error IS NULL THEN price_date END AS price_date,
  CASE WHEN error IS NULL THEN predicted_price END AS predicted_price,
  CASE WHEN error IS NULL THEN price END AS actual_price, CASE WHEN error IS NULL THEN confidence END AS confidence,
  CASE WHEN error IS NULL THEN CASE WHEN price = 0 THEN 0.0 ELSE (predicted_price - price) / price END END AS deviation
FROM {c_errors}"""
C_HISTORY = "SELECT *, abs(deviation) <= CAST(0.15 AS DOUBLE) AS within_threshold FROM {c_dev}"
CTES = {"c_f": C_FORECASTS, "c_target": C_TARGET, "c_dated": C_DATED, "c_undated": C_UNDATED, "c_priced": C_PRICED,
        "c_errors": C_ERRORS, "c_dev": C_DEV, "c_history": C_HISTORY}


def history_of(v: Views):
    """Deviation record of every stored forecast."""
    return dev.evaluate_batch(v.v_requests.select("symbol", "metrics_date"), v.v_metrics, v.v_eod)


@query("e01_target_date", """
SELECT symbol, CAST(metrics_date AS STRING) AS metrics_date,
  CAST(CAST(metrics_date + INTERVAL 30 DAY AS DATE) AS STRING) AS target_date FROM {v_requests}""")
def e01(v):
    return v.v_requests.select(
        "symbol", iso("metrics_date"), dev.target_date(F.col("metrics_date")).cast("string").alias("target_date"))


@query("e02_asof_price", """
SELECT symbol, CAST(metrics_date AS STRING) AS metrics_date, CAST(price_date AS STRING) AS price_date, price,
  CASE WHEN is_dated THEN 'dated' WHEN is_undated THEN 'undated' ELSE 'none' END AS origin FROM {c_priced}""", **CTES)
def e02(v):
    wanted = v.v_requests.select("symbol", "metrics_date", dev.target_date(F.col("metrics_date")).alias("target_date"))
    rows = dev.as_of_price(wanted, v.v_eod)
    return rows.select(
        "symbol", iso("metrics_date"), iso("price_date"),
        dev.pick_price(F.col("close"), F.col("adj_close")).alias("price"), F.col("price_origin").alias("origin"))


@query("e03_price_pick", """
SELECT symbol, ord, coalesce(nullif(close, 0), adj_close) AS price FROM {v_eod}""")
def e03(v):
    return v.v_eod.select("symbol", "ord", dev.pick_price(F.col("close"), F.col("adj_close")).alias("price"))


@query("e04_deviation", """
SELECT symbol, CAST(date AS STRING) AS date, deviation, deviation * 100 AS deviation_pct, within_threshold
FROM {c_history} WHERE error IS NULL""", **CTES)
def e04(v):
    rows = history_of(v).where("error is null")
    return rows.select("symbol", iso("date"), "deviation", "deviation_pct", "within_threshold")


@query("e05_evaluate_batch", """
SELECT symbol, CAST(date AS STRING) AS date, CAST(target AS STRING) AS target_date,
  CAST(price_date AS STRING) AS price_date, predicted_price, actual_price, deviation, within_threshold, confidence, error
FROM {c_history}""", **CTES)
def e05(v):
    return history_of(v).select(
        "symbol", iso("date"), iso("target_date"), iso("price_date"), "predicted_price", "actual_price", "deviation",
        "within_threshold", "confidence", "error")


@query("e06_history_append", """
SELECT symbol, CAST(date AS STRING) AS date, within_threshold, evaluation_date FROM {c_history},
  (SELECT '2001-01-30' AS evaluation_date UNION ALL SELECT '2001-01-31') d""", **CTES)
def e06(v):
    path = scratch_dir(v.spark, "history")
    # Appended twice, worked out once.
    records = materialize(history_of(v), "history-records")
    dev.append_history(records, path, "2001-01-30")
    dev.append_history(records, path, "2001-01-31")
    return v.spark.read.parquet(path).select("symbol", iso("date"), "within_threshold", iso("evaluation_date"))


_STATS = """
SELECT {by}COUNT(*) AS history_rows, COUNT(within_threshold) AS total,
  COUNT(*) FILTER (WHERE NOT within_threshold) AS misses,
  AVG(abs(deviation)) FILTER (WHERE NOT within_threshold) AS mean_abs,
  AVG(deviation) FILTER (WHERE NOT within_threshold) AS mean_signed FROM {{c_history}}{group}"""
C_BY_SYMBOL = _STATS.format(by="symbol, ", group=" GROUP BY symbol")
C_OVERALL = _STATS.format(by="'all' AS symbol, ", group="")
_DECIDED = """
SELECT symbol, total, CASE WHEN total >= 5 THEN misses ELSE 0 END AS failure_count,
  CASE WHEN total >= 5 THEN misses / total ELSE 0.0 END AS failure_rate,
  CASE WHEN total >= 5 THEN coalesce(mean_abs, 0.0) END AS avg_deviation,
  CASE WHEN total >= 5 THEN coalesce(mean_signed, 0.0) END AS avg_signed,
  CASE WHEN total >= 5 THEN CASE WHEN mean_signed > 0 THEN 'overestimate' ELSE 'underestimate' END END AS bias_direction,
  total >= 5 AND misses / total > 0.5 AS needs_correction,
  CASE WHEN history_rows = 0 THEN 'no_history' WHEN total < 5 THEN 'insufficient_samples'
    WHEN NOT (misses / total > 0.5) THEN 'within_threshold' END AS reason FROM {{{src}}}"""
C_DECIDED = _DECIDED.format(src="c_by_symbol")
BIAS = {**CTES, "c_by_symbol": C_BY_SYMBOL, "c_decided": C_DECIDED}
OVERALL = {**CTES, "c_by_symbol": C_OVERALL, "c_decided": C_DECIDED}


@query("e07_valid_samples", """
SELECT symbol, total AS total_samples, total < 5 AS insufficient FROM {c_by_symbol}""", **BIAS)
def e07(v):
    rows = b.analyze(history_of(v), ["symbol"])
    return rows.select("symbol", "total_samples", F.col("analysis_reason").isNotNull().alias("insufficient"))


@query("e08_failure_stats", """
SELECT symbol, failure_count, round(failure_rate, 6) AS failure_rate, round(avg_deviation, 6) AS avg_deviation,
  round(avg_signed, 6) AS avg_signed_deviation FROM {c_decided}""", **BIAS)
def e08(v):
    rows = b.analyze(history_of(v), ["symbol"])
    return rows.select("symbol", "failure_count", *[
        F.round(c, 6).alias(c) for c in ("failure_rate", "avg_deviation", "avg_signed_deviation")])


@query("e09_bias_direction", """
SELECT total AS total_samples, failure_count, round(failure_rate, 6) AS failure_rate, bias_direction, needs_correction
FROM {c_decided}""", **OVERALL)
def e09(v):
    rows = b.analyze(history_of(v))
    return rows.select("total_samples", "failure_count", F.round("failure_rate", 6).alias("failure_rate"),
                       "bias_direction", "needs_correction")


@query("e10_decision", """
SELECT symbol, CASE WHEN needs_correction THEN 'corrected' ELSE 'skip' END AS action, reason, bias_direction
FROM {c_decided}""", **BIAS)
def e10(v):
    return b.decide(b.analyze(history_of(v), ["symbol"])).select("symbol", "action", "reason", "bias_direction")


_ADVICE = """'Adjust for ' || bias_direction || ' bias. Average deviation: ' || printf('%.2f', avg_deviation * 100)
  || '%. Failure rate: ' || printf('%.1f', failure_rate * 100) || '% (' || failure_count || '/' || total || ' samples).'"""


@query("e11_correction_event", f"""
SELECT '2001-01-31T00:00:00' AS timestamp, 'high_failure_rate' AS trigger, bias_direction, {_ADVICE} AS recommendation
FROM {{c_decided}} WHERE needs_correction""", **BIAS)
def e11(v):
    decisions = b.decide(b.analyze(history_of(v), ["symbol"]))
    events = b.correction_events(decisions, F.lit("2001-01-31T00:00:00"))
    return events.select("timestamp", "trigger", "bias_direction", "recommendation")


def versions_of(v: Views):
    """Document texts as the version history of one prompt per document source."""
    return v.documents.select(
        F.col("source").alias("prompt"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("version_ts"),
        F.col("text").alias("content"))


@query("e12_version_ranges", """
SELECT source AS prompt, 1704067200 + doc_id * 3600 AS valid_from,
  coalesce(LEAD(1704067200 + doc_id * 3600) OVER (PARTITION BY source ORDER BY doc_id), -1) AS valid_to, md5(text) AS digest
FROM {documents}""")
def e12(v):
    rows = b.version_ranges(versions_of(v))
    return rows.select(
        "prompt", F.unix_timestamp("valid_from").alias("valid_from"),
        F.coalesce(F.unix_timestamp("valid_to"), F.lit(-1)).alias("valid_to"), F.md5("content").alias("digest"))


@query("e12_apply_correction", f"""
SELECT source AS prompt, md5(arg_max(text, doc_id) || chr(10) || chr(10) || '---' || chr(10)
  || '## Auto-Correction Applied (2001-01-31T00:00:00)' || chr(10) || chr(10) || '**Trigger:** high_failure_rate' || chr(10)
  || '**Bias Direction:** ' || any_value(bias_direction) || chr(10) || '**Recommendation:** ' || any_value(advice) || chr(10)
  || chr(10) || 'Adjust your confidence scoring and price predictions to account for systematic '
  || any_value(bias_direction) || ' bias observed in ' || printf('%.0f', any_value(failure_rate) * 100)
  || '% of recent predictions.' || chr(10)) AS digest
FROM {{documents}}, (SELECT *, {_ADVICE} AS advice FROM {{c_decided}} WHERE needs_correction) e GROUP BY source""", **OVERALL)
def e12_apply(v):
    decisions = b.decide(b.analyze(history_of(v)))
    events = b.correction_events(decisions, F.lit("2001-01-31T00:00:00"))
    return b.apply_corrections(versions_of(v), events).select("prompt", F.md5("content").alias("digest"))


@query("e13_miss_streaks", """
SELECT symbol, CAST(MIN(date) AS STRING) AS first_date, CAST(MAX(date) AS STRING) AS last_date, COUNT(*) AS streak
FROM (SELECT *, SUM(CASE WHEN within_threshold THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS g
  FROM {c_history} WHERE within_threshold IS NOT NULL) t
WHERE NOT within_threshold GROUP BY symbol, g HAVING COUNT(*) >= 3""", **CTES)
def e13(v):
    # The two-level running total reads its input twice; in production that is the stored history table.
    return b.miss_streaks(materialize(history_of(v), "history")).select("symbol", iso("first_date"), iso("last_date"), "streak")


@query("e14_meta_review", """
SELECT symbol, total AS total_samples, passes AS pass_count, total - passes AS fail_count,
  round(passes / total, 4) AS pass_rate, round(mean_abs, 4) AS avg_deviation,
  CASE WHEN round(mean_signed, 4) > 0 THEN 'overestimate' WHEN round(mean_signed, 4) < 0 THEN 'underestimate'
    ELSE 'neutral' END AS direction, abs(round(mean_signed, 4)) AS magnitude,
  round(greatest(ups, downs) / total, 4) AS consistency,
  CASE WHEN passes / total > 0.8 THEN 'no_action' WHEN greatest(ups, downs) >= 5 THEN 'correct' ELSE 'monitor' END AS action
FROM (SELECT symbol, COUNT(*) AS total, COUNT(*) FILTER (WHERE within_threshold) AS passes, AVG(abs(deviation)) AS mean_abs,
  AVG(deviation) AS mean_signed, COUNT(*) FILTER (WHERE deviation > 0) AS ups, COUNT(*) FILTER (WHERE deviation < 0) AS downs
  FROM {c_history} WHERE within_threshold IS NOT NULL GROUP BY symbol) t""", **CTES)
def e14(v):
    return b.meta_review(history_of(v), ["symbol"])


@query("e15_bias_by_factor", """
SELECT coalesce(sector, '(none)') AS sector, CAST(GROUPING(sector) AS INT) AS is_total, COUNT(*) AS samples,
  COUNT(*) FILTER (WHERE NOT within_threshold) AS misses, round(AVG(deviation), 6) AS mean_deviation
FROM {c_history} h LEFT JOIN {v_profile} p ON h.symbol = p.symbol WHERE within_threshold IS NOT NULL
GROUP BY GROUPING SETS ((sector), ())""", **CTES)
def e15(v):
    rows = b.bias_by_factor(history_of(v), v.v_profile)
    return rows.select(F.coalesce("sector", F.lit("(none)")).alias("sector"), F.col("is_total").cast("int").alias("is_total"),
                       "samples", "misses", F.round("mean_deviation", 6).alias("mean_deviation"))
