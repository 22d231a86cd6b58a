"""Stage outcomes of research runs: final results, attempt rules and summaries.

A run is (run_date, symbol); the attempt log has one row per stage attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.ordered import running_total
from tickerloom.functions.scalars import truncate_with_note
from tickerloom.sources.scans import first_per_group

RUN = ["run_date", "symbol"]
# --- fixed values: attempts allowed per stage --------------------------------
MAX_ATTEMPTS = {"drafter": 2, "reviewer": 1, "reviser": 2}


def final_outcomes(attempts: DataFrame, artifacts: DataFrame, url_checks: DataFrame) -> DataFrame:
    """Success and final gate of every run.

    The last reviser attempt that ran to its end supplies the final gate; the
    URL check may be absent.  A run succeeds with a non-empty report and
    non-empty metrics; without a report it was aborted before the reviser.
    """
    last = lambda stage, value, cond: F.max_by(value, F.when((F.col("stage") == stage) & cond, F.col("attempt")))
    ran = F.col("success")
    folded = attempts.groupBy(*RUN).agg(
        F.count("*").alias("attempts"),
        F.sum("duration_seconds").alias("duration_seconds"),
        last("drafter", F.col("gate_passed"), ran).alias("draft_gate"),
        last("reviser", F.col("gate_passed"), ran).alias("final_gate"),
        last("drafter", F.col("error"), F.lit(True)).alias("drafter_error"),
    )
    texts = artifacts.select(*RUN, "report_chars", "metrics_fields")
    joined = folded.join(texts, RUN, "left").join(url_checks.select(*RUN, F.col("passed").alias("url_passed")), RUN, "left")
    report = F.coalesce("report_chars", F.lit(0)) > 0
    metrics = F.coalesce("metrics_fields", F.lit(0)) > 0
    return joined.select(
        *RUN, "attempts", "duration_seconds", "draft_gate",
        (report & F.coalesce("final_gate", F.lit(False)) & F.coalesce("url_passed", F.lit(True))).alias("final_gate_passed"),
        (report & metrics).alias("success"),
        F.when(F.col("report_chars").isNull(), F.lit("no_report")).alias("error"),
    )


def attempt_violations(attempts: DataFrame) -> DataFrame:
    """Attempts that the retry rules forbid, with the rule broken.

    The first pass and the first failed invocation of a stage come from one
    combined aggregate; joining it back splits well even if a single stage has
    very many attempts.
    """
    keys = [*RUN, "stage"]
    firsts = attempts.groupBy(*keys).agg(
        F.min(F.when(F.col("gate_passed"), F.col("attempt"))).alias("first_pass"),
        F.min(F.when(~F.col("success"), F.col("attempt"))).alias("first_failure"),
    )
    allowed = F.create_map(*[F.lit(x) for kv in MAX_ATTEMPTS.items() for x in kv])
    broken = F.array_compact(F.array(
        F.when(F.col("attempt") > F.col("first_pass"), "after_pass"),
        F.when(F.col("attempt") > F.col("first_failure"), "after_failure"),
        F.when(F.col("attempt") > allowed[F.col("stage")], "beyond_max"),
    ))
    return (
        attempts.join(firsts, keys)
        .withColumn("broken", broken)
        .where(F.size("broken") > 0)
        .select(*keys, "attempt", "broken")
    )


#: Outcomes that a run's nested record holds at most; the rest is counted there and stands in the long form.
NESTED_OUTCOMES = 100
#: Attempts per bucket of the long form's ranking: no task sorts more of a run's stage.
_RANK_BUCKET = 10_000


def _with_stage_no(attempts: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, s in enumerate(MAX_ATTEMPTS) for x in (s, i)])
    return attempts.select(*RUN, order[F.col("stage")].alias("stage_no"), "attempt", "stage", "success", "duration_seconds", "error")


def ranked_outcomes(attempts: DataFrame) -> DataFrame:
    """Long form: every attempt with its place in the run, from 1, by stage and attempt.

    Nothing is cut.  A run of any length is ranked in buckets of attempts.
    """
    bucket = F.struct("stage_no", F.floor(F.col("attempt") / _RANK_BUCKET).alias("part"))
    order = ["stage_no", "attempt", "success", "duration_seconds", "error"]
    return running_total(_with_stage_no(attempts), RUN, order, F.lit(1), bucket, "rank").drop("stage_no")


def run_records(attempts: DataFrame, artifacts: DataFrame, nested: int = NESTED_OUTCOMES) -> DataFrame:
    """Nested record per run: ordered outcomes, artifact keys and text sizes.

    ``stage_outcomes`` holds the first ``nested`` outcomes, ``more_outcomes`` counts those beyond, which ``ranked_outcomes``
    lists.  Surplus rows are dropped in each task before the shuffle, so a run may have any number of attempts; the retry rules
    allow fewer than a record holds.  Files of a run are bounded by the file list.
    """
    numbered = _with_stage_no(attempts)
    fields = ["stage_no", "attempt", "stage", "success", "duration_seconds", "error"]
    head = first_per_group(numbered, RUN, [F.col(c) for c in fields], nested)
    folded = head.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("ranked"))
    heads = folded.select(*RUN, F.transform("ranked", lambda o: F.struct(*[o[c].alias(c) for c in fields])).alias("stage_outcomes"))
    counts = attempts.groupBy(*RUN).agg(F.greatest(F.count("*") - nested, F.lit(0)).alias("more_outcomes"))
    sizes = artifacts.select(
        *RUN, "artifact_keys",
        F.coalesce("notes_chars", F.lit(0)).alias("research_notes_chars"),
        F.coalesce("critique_chars", F.lit(0)).alias("critique_chars"),
    )
    return heads.join(counts, RUN).join(sizes, RUN, "left")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Success and failure counts per run date."""
    return outcomes.groupBy("run_date").agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.count_if("final_gate_passed").alias("final_gate_passed"),
    )


def failed_run_snapshots(outcomes: DataFrame, files: DataFrame, max_chars: int = fv.SNAPSHOT_MAX_CHARS) -> DataFrame:
    """Known files of failed runs, long texts cut with a note on their full length."""
    failed = outcomes.where(~F.col("success")).select(*RUN)
    known = files.where(F.col("file_name").isin(fv.SNAPSHOT_FILES) & F.col("text").isNotNull())
    return known.join(failed, RUN, "left_semi").select(
        *RUN,
        F.concat_ws("/", "bucket", "file_name").alias("artifact_key"),
        truncate_with_note(F.col("text"), max_chars).alias("text"),
    )
