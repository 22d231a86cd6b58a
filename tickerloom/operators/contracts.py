"""Checks the research contract states about documents, as row-wise expressions.

Where a document falls apart into several rows (chapters, log entries,
references) the rows come from exploding that document's own array, so a
document is never gathered from elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions import text as tx
from tickerloom.functions.collections import looks_like_object, strict_json

REFERENCE_ENTRY = r"(?md)^\[(\d+)\] [^\n]*(https?://[^\s]+)[^\n]*Accessed \d{4}-\d{2}-\d{2}"
SCORE_ROW = r"(?md)^\| [^|\n]+ \| (\d)/5 \|"
PROGRESS_LINE = r"(?md)^\[\d{2}:\d{2}:\d{2}\] [^\s]+$"


def _pieces(c: Column, heading: str) -> Column:
    """Cut a text before every line starting with ``heading``; text ahead of the first is dropped."""
    return F.filter(F.split(c, f"(?md)(?=^{heading})"), lambda p: p.startswith(heading))


def unlogged_urls(docs: DataFrame) -> DataFrame:
    """URLs a report cites that its research log does not contain."""
    cited = F.array_distinct(tx.urls(F.col("report")))
    logged = F.coalesce(tx.urls(F.col("research_notes")), F.array().cast("array<string>"))
    return docs.where(F.col("report").isNotNull()).select(
        "doc_key", F.size(cited).alias("cited"), F.array_except(cited, logged).alias("unlogged"))


def chapters(docs: DataFrame) -> DataFrame:
    """One row per H2 section with its ordinal, title and body."""
    cut = docs.select("doc_key", F.posexplode(_pieces(F.col("report"), "## ")).alias("pos", "piece"))
    first_line = F.substring_index("piece", "\n", 1)
    body = F.substring(F.col("piece"), F.length(first_line) + 1, F.length("piece"))
    return cut.select(
        "doc_key",
        (F.col("pos") + 1).alias("ordinal"),
        F.substring(first_line, F.lit(4), F.length(first_line)).alias("title"),
        F.btrim(body, F.lit("\n")).alias("body"),
    )


def tier_consistency(docs: DataFrame) -> DataFrame:
    """Tier in the first and last chapter against the recommendation's tier."""
    pieces = _pieces(F.col("report"), "## ")
    tier_of = lambda head: F.nullif(F.regexp_extract(
        F.coalesce(F.get(F.filter(pieces, lambda p: p.startswith(head)), F.lit(0)), F.lit("")), fv.TIER_PATTERN, 0),
        F.lit(""))
    body = F.when(strict_json(F.col("metrics_json")), F.get_json_object("metrics_json", "$.subscription_recommendation"))
    mapping = F.create_map(*[F.lit(x) for pair in fv.TIER_BY_RECOMMENDATION for x in pair])
    out = docs.where(F.col("report").isNotNull()).select(
        "doc_key", tier_of("## 一、").alias("opening_tier"), tier_of("## 八、").alias("closing_tier"),
        mapping[body].alias("metric_tier"))
    same = (F.col("opening_tier") == F.col("closing_tier")) & (F.col("closing_tier") == F.col("metric_tier"))
    return out.withColumn("consistent", F.coalesce(same, F.lit(False)))


def expected_action(total: Column, fixes: Column) -> Column:
    return (
        F.when((total >= fv.PUBLISH_FLOOR) & (fixes == 0), "publish_as_is")
        .when(total < fv.REDRAFT_CEILING, "redraft_from_scratch")
        .otherwise("revise")
    )


def parse_critique(docs: DataFrame) -> DataFrame:
    """Verdict, scores, stated total, required fixes and next action of a critique."""
    text = F.col("critique")
    found = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    scores = F.regexp_extract_all(text, F.lit(SCORE_ROW), F.lit(1))
    fixes = F.get(_pieces(text, "## Required Fixes"), F.lit(0))
    only_fixes = F.get(F.split(fixes, r"(?md)(?=^## (?!Required))"), F.lit(0))
    parsed = docs.where(text.isNotNull()).select(
        "doc_key",
        found(r"\*\*(" + "|".join(fv.CRITIQUE_VERDICTS) + r")\*\*", 1).alias("verdict"),
        F.size(scores).alias("dimensions"),
        F.aggregate(scores, F.lit(0), lambda acc, s: acc + s.cast("int")).alias("score_sum"),
        found(r"\*\*Total: (\d+) / 50\*\*", 1).cast("int").alias("stated_total"),
        F.coalesce(tx.hits(only_fixes, r"(?md)^\d+\. "), F.lit(0)).alias("required_fixes"),
        found(r"\*\*(" + "|".join(fv.CRITIQUE_ACTIONS) + r")\*\*", 1).alias("next_action"),
    )
    want = expected_action(F.col("stated_total"), F.col("required_fixes"))
    return (
        parsed.withColumn("total_agrees", F.coalesce(F.col("score_sum") == F.col("stated_total"), F.lit(False)))
        .withColumn("expected_action", want)
        .withColumn("action_agrees", F.coalesce(F.col("next_action") == want, F.lit(False)))
    )


def research_queries(docs: DataFrame) -> DataFrame:
    """One row per logged query with its first URL, or the mark that nothing was found."""
    cut = docs.select("doc_key", F.posexplode(_pieces(F.col("research_notes"), "### Query: ")).alias("pos", "entry"))
    url = F.get(tx.urls(F.col("entry")), F.lit(0))
    first_line = F.substring_index("entry", "\n", 1)
    return cut.select(
        "doc_key",
        (F.col("pos") + 1).alias("ordinal"),
        F.btrim(F.substring(first_line, F.lit(len("### Query: ") + 1), F.length(first_line)), F.lit('" ')).alias("query"),
        url.alias("url"),
        F.when(url.isNotNull(), "url").when(F.contains("entry", F.lit("no usable result")), "no_result")
        .otherwise("unanswered").alias("outcome"),
    )


def research_coverage(docs: DataFrame, minimum: int = fv.MIN_RESEARCH_QUERIES) -> DataFrame:
    """Number of logged queries per document and whether it reaches the minimum."""
    n = F.size(_pieces(F.col("research_notes"), "### Query: "))
    return docs.where(F.col("research_notes").isNotNull()).select(
        "doc_key", n.alias("queries"), (n >= minimum).alias("enough"))


def metric_rules(docs: DataFrame) -> DataFrame:
    """Domain rule violations of a metrics document (valid objects only)."""
    text = F.col("metrics_json")
    body = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>"), F.lit(0))
    valid = docs.where(strict_json(text) & looks_like_object(text)).withColumn("m", body)
    value = lambda k: F.col("m")[k]
    unit = lambda k: F.when(~F.coalesce(value(k).try_cast("double").between(0, 1), F.lit(False)), k + "_range")
    missing = F.array_except(F.array(*[F.lit(k) for k in fv.METRIC_SCHEMA_KEYS]), F.map_keys("m"))
    one_of = lambda k, allowed: F.when(~F.coalesce(value(k).isin(allowed), F.lit(False)), k + "_value")
    confidence = value("confidence").try_cast("double")
    return valid.select(
        "doc_key",
        F.array_compact(F.array(
            F.when(F.size(missing) > 0, "fields_missing"),
            one_of("market", fv.MARKETS),
            unit("confidence"),
            one_of("signal", fv.SIGNALS),
            unit("risk_score"),
            F.when(F.coalesce(value("sector").isin(fv.EMPTY_MARKERS), F.lit(True)), "sector_value"),
            unit("data_completeness"),
            one_of("subscription_recommendation", fv.RECOMMENDATIONS),
        )).alias("violations"),
        F.size(missing).alias("missing_fields"),
        F.when(confidence <= 0.4, "thin").when(confidence >= 0.7, "strong").when(confidence.isNotNull(), "medium")
        .alias("confidence_band"),
    )


def line_counts(docs: DataFrame) -> DataFrame:
    """Counts by line (a line with three URLs counts once), unlike the gate's occurrence counts."""
    return docs.where(F.col("report").isNotNull()).select(
        "doc_key",
        tx.matching_lines(F.col("report"), "https?://").alias("url_lines"),
        tx.matching_lines(F.col("report"), fv.MISSING_PHRASE).alias("missing_phrase_lines"),
        tx.matching_lines(F.col("report"), "^## [一二三四五六七八]、").alias("chapter_lines"),
        F.coalesce(tx.matching_lines(F.col("research_notes"), "https?://"), F.lit(0)).alias("research_url_lines"),
    )


def _marks() -> Column:
    """(milestone, second of the day) of every well-formed progress line, in order."""
    lines = tx.find_all(F.col("log"), PROGRESS_LINE)
    part = lambda line, at: F.substring(line, at, 2).cast("int")
    return F.transform(lines, lambda line: F.struct(
        F.substring(line, F.lit(12), F.length(line)).alias("milestone"),
        (part(line, 2) * 3600 + part(line, 5) * 60 + part(line, 8)).alias("second")))


def progress_steps(logs: DataFrame) -> DataFrame:
    """One row per milestone with the time since the one before (midnight wraps)."""
    marked = logs.withColumn("marks", _marks())
    gaps = F.transform("marks", lambda m, i: F.struct(
        m["milestone"].alias("milestone"), m["second"].alias("second"),
        F.when(i > 0, (m["second"] - F.get("marks", i - 1)["second"] + 86400) % 86400).alias("gap_seconds")))
    return marked.select("doc_key", F.posexplode(gaps).alias("pos", "s")).select(
        "doc_key", (F.col("pos") + 1).alias("ordinal"), "s.milestone", "s.second", "s.gap_seconds")


def missing_milestones(logs: DataFrame) -> DataFrame:
    """Required milestones a progress log never reached, in their required order."""
    seen = F.transform(_marks(), lambda m: m["milestone"])
    required = F.array(*[F.lit(m) for m in fv.PROGRESS_MILESTONES])
    return logs.select("doc_key", F.array_except(required, seen).alias("missing"))


def tone_hits(docs: DataFrame, column: str = "report") -> DataFrame:
    """Occurrences of promise-like wording per document."""
    return docs.select("doc_key", F.coalesce(tx.hits(F.col(column), fv.BANNED_TONE), F.lit(0)).alias("tone_hits"))


def reference_check(docs: DataFrame, minimum: int = fv.MIN_REFERENCE_ENTRIES) -> DataFrame:
    """Reference entries, their minimum, and inline marks without an entry."""
    entries = F.regexp_extract_all("report", F.lit(REFERENCE_ENTRY), F.lit(1))
    marks = F.array_distinct(F.regexp_extract_all("report", F.lit(r"\[(\d+)\]"), F.lit(1)))
    return docs.where(F.col("report").isNotNull()).select(
        "doc_key",
        F.size(entries).alias("entries"),
        (F.size(entries) >= minimum).alias("enough"),
        F.array_except(marks, entries).alias("dangling"),
    )
