"""Document quality gate: every rule is a column expression, one pass, no shuffle.

Failures are short coded strings (``rule: observed, wanted``) in rule order, so
that severity, feedback text and statistics all derive from one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions import text as tx
from tickerloom.functions.collections import looks_like_object, strict_json


def thresholds(spark: SparkSession) -> DataFrame:
    """The two presets as a table."""
    schema = ("stage STRING, min_urls INT, max_unknown INT, required_chapters INT, max_nulls INT, "
              "min_research_urls INT, min_chars INT")
    return spark.createDataFrame(fv.GATE_THRESHOLDS, schema)


def with_thresholds(docs: DataFrame, presets: DataFrame | None = None) -> DataFrame:
    """Join each document's limits by stage; two preset rows, so the broadcast is bounded."""
    table = presets if presets is not None else thresholds(docs.sparkSession)
    return docs.join(F.broadcast(table), "stage", "left")


def measure(docs: DataFrame) -> DataFrame:
    """All counts the rules look at, for (report, metrics_json, research_notes, critique)."""
    report, metrics, notes = F.col("report"), F.col("metrics_json"), F.col("research_notes")
    valid = strict_json(metrics)
    values = F.from_json(F.concat(F.lit("["), metrics, F.lit("]")), "array<map<string,string>>")
    # A valid document that is not an object parses to no map and skips the field rules.
    fields = F.when(valid & looks_like_object(metrics), F.get(values, F.lit(0)))
    keys = F.map_keys("fields")
    empty = F.filter(F.map_values("fields"), lambda v: v.isNull() | v.isin(*fv.EMPTY_MARKERS))
    return (
        docs.withColumn("report_chars", F.length(report))
        .withColumn("tags", tx.language_tags(report))
        .withColumn("report_url_count", tx.url_count(report))
        .withColumn("unknown_phrase_count", tx.missing_phrase_count(report))
        .withColumn("numbered_chapter_count", tx.hits(report, fv.NUMBERED_CHAPTER))
        .withColumn("total_h2_count", tx.hits(report, fv.ANY_H2))
        .withColumn("metrics_valid", F.when(metrics.isNotNull(), valid))
        .withColumn("fields", fields)
        .withColumn("missing_keys", F.array_sort(F.array_except(
            F.array(*[F.lit(k) for k in fv.REQUIRED_METRIC_KEYS]), keys)))
        .withColumn("metrics_null_count", F.size(empty))
        .withColumn("recommendation", F.col("fields")["subscription_recommendation"])
        .withColumn("research_url_count", tx.url_count(notes))
        .withColumn("research_chars", F.length(notes))
        .withColumn("language_tag_violations", F.size("tags"))
        .withColumn("tag_samples", F.slice("tags", 1, 5))
        .drop("tags")
    )


def _say(label: str, *parts) -> Column:
    return F.concat(F.lit(label + ": "), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def check_rules(measured: DataFrame, *, require_critique: Column | bool = False) -> DataFrame:
    """Adds failures, warnings, severity and passed to measured documents with limits."""
    need_critique = require_critique if isinstance(require_critique, Column) else F.lit(require_critique)
    c = F.col
    has_fields = c("fields").isNotNull()
    n_missing = F.size("missing_keys")
    rules = [
        F.when(c("report_chars") < c("min_chars"),
               _say("report_too_short", c("report_chars"), " chars, floor ", c("min_chars"))),
        F.when(c("language_tag_violations") > 0,
               _say("language_tags", c("language_tag_violations"), " found, e.g. ", F.array_join("tag_samples", " "))),
        F.when(c("report_url_count") < c("min_urls"),
               _say("too_few_citations", c("report_url_count"), " URLs, floor ", c("min_urls"))),
        F.when(c("unknown_phrase_count") > c("max_unknown"),
               _say("missing_info_phrases", c("unknown_phrase_count"), " found, ceiling ", c("max_unknown"))),
        F.when(c("numbered_chapter_count") < c("required_chapters"),
               _say("too_few_chapters", c("numbered_chapter_count"), " numbered, floor ", c("required_chapters"))),
        F.when(c("metrics_json").isNull(), F.lit("metrics_missing")),
        F.when(c("metrics_json").isNotNull() & ~c("metrics_valid"), F.lit("metrics_invalid_json")),
        F.when(has_fields & (n_missing > 0), _say("metrics_keys_missing", F.array_join("missing_keys", ","))),
        F.when(has_fields & (c("metrics_null_count") > c("max_nulls")),
               _say("metrics_empty_fields", c("metrics_null_count"), " fields, ceiling ", c("max_nulls"))),
        F.when(has_fields & c("recommendation").isNotNull() & ~c("recommendation").isin(fv.RECOMMENDATIONS),
               _say("metrics_bad_recommendation", c("recommendation"))),
        F.when(c("research_notes").isNull(), F.lit("research_notes_missing")),
        F.when(c("research_url_count") < c("min_research_urls"),
               _say("too_few_research_urls", c("research_url_count"), " URLs, floor ", c("min_research_urls"))),
        F.when(need_critique & c("critique").isNull(), F.lit("critique_missing")),
    ]
    warning = F.when(
        c("total_h2_count") > c("numbered_chapter_count") + 3,
        _say("extra_headings", c("total_h2_count"), " H2 for ", c("numbered_chapter_count"), " chapters"),
    )
    none = F.array().cast("array<string>")
    no_report = c("report").isNull()
    failures = F.when(no_report, F.array(F.lit("report_missing"))).otherwise(F.array_compact(F.array(*rules)))
    warnings = F.when(no_report, none).otherwise(F.array_compact(F.array(warning)))
    return with_verdict(measured.withColumn("failures", failures).withColumn("warnings", warnings))


def with_verdict(df: DataFrame) -> DataFrame:
    """passed and severity from the failures array."""
    n = F.size("failures")
    severity = F.when(n == 0, "pass").when(n <= 2, "soft_fail").otherwise("hard_fail")
    return df.withColumn("passed", n == 0).withColumn("severity", severity)


METRIC_COLUMNS = [
    "report_chars", "language_tag_violations", "report_url_count", "unknown_phrase_count", "numbered_chapter_count",
    "total_h2_count", "metrics_null_count", "research_url_count", "research_chars",
]


def gate_metrics(df: DataFrame) -> Column:
    """Measured values as a map; measures that were not taken are left out."""
    pairs = [F.when(F.col(m).isNotNull(), F.struct(F.lit(m), F.col(m).cast("double"))) for m in METRIC_COLUMNS]
    kept = F.when(F.col("report").isNotNull(), F.array_compact(F.array(*pairs)))
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast("map<string,double>"))


def check_documents(docs: DataFrame, *, require_critique: Column | bool = False) -> DataFrame:
    """Gate result struct of every document: passed, severity, failures, warnings, metrics."""
    checked = check_rules(measure(with_thresholds(docs)), require_critique=require_critique)
    return checked.withColumn("metrics", gate_metrics(checked))


def report_urls(docs: DataFrame) -> DataFrame:
    """Distinct URLs of every report in order of first appearance."""
    return docs.select("doc_key", F.posexplode(F.array_distinct(tx.urls(F.col("report")))).alias("pos", "url"))


def verify_urls(
    docs: DataFrame, url_status: DataFrame, *, sample_size: int = 5, min_ok_ratio: float = 0.5, seed: int = 17
) -> DataFrame:
    """Reachability verdict per document from a seeded sample of its distinct URLs.

    ``url_status`` is (url, status) with one row per URL, status null for no
    response.  The sample is drawn inside the report's row.  URLs are cited from
    many reports, so the join runs on the sampled pairs only, and AQE splits a
    URL everyone cites.  The listed bad URLs are at most those of one row.
    """
    found = F.array_distinct(tx.urls(F.col("report")))
    drawn = F.array_sort(F.transform(found, lambda u, i: F.struct(F.xxhash64(u, F.lit(seed)).alias("h"), i.alias("pos"), u.alias("url"))))
    sampled = docs.select("doc_key", F.posexplode(F.slice(drawn, 1, sample_size)).alias("at", "u")).select(
        "doc_key", F.col("u.url").alias("url"), (F.col("at") + 1).alias("draw"))
    seen = sampled.join(url_status, "url", "left")
    ok = F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False))
    bad = F.sort_array(F.collect_list(F.when(~ok, F.struct("draw", "url"))))
    stats = seen.groupBy("doc_key").agg(
        F.count("*").alias("sampled"), F.count_if(ok).alias("ok"),
        F.transform(F.slice(bad, 1, 3), lambda x: x["url"]).alias("bad_examples"))
    joined = docs.select("doc_key", F.col("report").isNull().alias("no_report")).join(stats, "doc_key", "left")
    n, good = F.coalesce("sampled", F.lit(0)), F.coalesce("ok", F.lit(0))
    ratio = F.when(n > 0, good / n).otherwise(F.lit(0.0))
    failure = (
        F.when(F.col("no_report"), F.lit("report_missing"))
        .when(n == 0, F.lit("no_urls"))
        .when(ratio < min_ok_ratio, _say("unreachable_urls", good, "/", n, " ok"))
    )
    return joined.select(
        "doc_key", n.alias("sampled"), good.alias("ok"), F.round(ratio, 3).alias("ok_ratio"),
        failure.isNull().alias("passed"), failure.alias("failure"),
        F.coalesce(F.when(ratio < min_ok_ratio, F.col("bad_examples")), F.array().cast("array<string>"))
        .alias("bad_examples"),
    )


def combine(results: DataFrame) -> DataFrame:
    """Merge several gate results per document; any failure fails the whole.

    ``results`` has doc_key, seq, failures, warnings and metrics; lists are
    joined in ``seq`` order and the last value of a metric wins.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("seq", "failures", "warnings", "metrics")), lambda a, b: a["seq"] - b["seq"])
    part = lambda name: F.flatten(F.transform("r", lambda x: x[name]))
    # Later maps override earlier ones: drop an earlier map's keys that a later map has.
    merged = F.aggregate(
        F.transform("r", lambda x: x["metrics"]),
        F.create_map().cast("map<string,double>"),
        lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m),
    )
    folded = results.groupBy("doc_key").agg(ordered.alias("r"))
    return with_verdict(folded.select(
        "doc_key", part("failures").alias("failures"), part("warnings").alias("warnings"), merged.alias("metrics")))


def feedback_text(stage: Column) -> Column:
    """Numbered failures, then numbered warnings; empty for a passed document."""
    numbered = lambda a: F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    fail = F.concat(F.lit("Quality gate rejected the "), stage, F.lit(" submission:\n"),
                    F.array_join(numbered(F.col("failures")), "\n"))
    warn = F.when(F.size("warnings") > 0, F.concat(
        F.lit("\nWarnings:\n"), F.array_join(numbered(F.col("warnings")), "\n"))).otherwise(F.lit(""))
    return F.when(F.col("passed"), F.lit("")).otherwise(F.concat(fail, warn))
