"""Document gate, contract checks and stage outcome plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import contracts as ct
from tickerloom.operators import gate as g
from tickerloom.operators import outcomes as oc
from tickerloom.plans.registry import iso, joined, query
from tickerloom.plans.views import Views

# RE2 spelling of the fixed patterns (no (?U); the composed texts use plain white space).
_URL = "https?://[^\\s\\)\\]\\>\"'']+"
_MISSING = "(?i)Not available|N/A|Unknown|无法评估|暂无数据|数据缺失|信息缺失|未提供"
_HALF = "(?i)\\((?:English|EN|中文|ZH|中|英|英文)\\)"
_FULL = "(?i)（(?:中文|英文|EN|ZH|中|英|English)）"
_CHAPTER = "(?m)^##\\s+[一二三四五六七八九十]+、"
_H2 = "(?m)^##\\s+\\S"


def _n(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS BIGINT)"


C_MEASURED = f"""
SELECT *, json_type(j) AS jtype, json_type(j) = 'OBJECT' AS is_object,
  CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(list_filter(['symbol', 'analysis_date', 'subscription_recommendation',
    'confidence', 'signal', 'risk_score'], lambda k: NOT list_contains(json_keys(j), k))), ',') END AS missing_keys,
  CASE WHEN json_type(j) = 'OBJECT' THEN len(list_filter(json_keys(j),
    lambda k: coalesce(json_extract_string(j, '$."' || k || '"'), '') IN ('', 'Unknown'))) END AS metrics_null_count,
  CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.subscription_recommendation') END AS recommendation
FROM (SELECT *, CASE WHEN json_valid(metrics_json) THEN metrics_json END AS j, length(report) AS report_chars,
    list_concat(regexp_extract_all(report, '{_HALF}'), regexp_extract_all(report, '{_FULL}')) AS tags,
    {_n('report', _URL)} AS report_url_count, {_n('report', _MISSING)} AS unknown_phrase_count,
    {_n('report', _CHAPTER)} AS numbered_chapter_count, {_n('report', _H2)} AS total_h2_count,
    {_n('research_notes', _URL)} AS research_url_count, length(research_notes) AS research_chars,
    CASE WHEN stage = 'draft' THEN 6 ELSE 7 END AS min_urls, CASE WHEN stage = 'draft' THEN 8 ELSE 5 END AS max_unknown,
    CASE WHEN stage = 'draft' THEN 5 ELSE 3 END AS max_nulls, CASE WHEN stage = 'draft' THEN 3000 ELSE 3500 END AS min_chars
  FROM {{v_reports}}) a"""
C_RULES = """
SELECT *, CASE WHEN report IS NULL THEN 'report_missing' ELSE concat_ws('; ',
  CASE WHEN report_chars < min_chars THEN 'report_too_short: ' || report_chars || ' chars, floor ' || min_chars END,
  CASE WHEN len(tags) > 0 THEN 'language_tags: ' || len(tags) || ' found, e.g. ' || array_to_string(list_slice(tags, 1, 5), ' ') END,
  CASE WHEN report_url_count < min_urls THEN 'too_few_citations: ' || report_url_count || ' URLs, floor ' || min_urls END,
  CASE WHEN unknown_phrase_count > max_unknown THEN 'missing_info_phrases: ' || unknown_phrase_count || ' found, ceiling ' || max_unknown END,
  CASE WHEN numbered_chapter_count < 8 THEN 'too_few_chapters: ' || numbered_chapter_count || ' numbered, floor 8' END,
  CASE WHEN metrics_json IS NULL THEN 'metrics_missing' WHEN j IS NULL THEN 'metrics_invalid_json' END,
  CASE WHEN missing_keys <> '' THEN 'metrics_keys_missing: ' || missing_keys END,
  CASE WHEN metrics_null_count > max_nulls THEN 'metrics_empty_fields: ' || metrics_null_count || ' fields, ceiling ' || max_nulls END,
  CASE WHEN recommendation NOT IN ('strong_buy', 'subscribe', 'cautious', 'avoid') THEN 'metrics_bad_recommendation: ' || recommendation END,
  CASE WHEN research_notes IS NULL THEN 'research_notes_missing'
    WHEN research_url_count < min_urls THEN 'too_few_research_urls: ' || research_url_count || ' URLs, floor ' || min_urls END,
  CASE WHEN stage = 'final' AND critique IS NULL THEN 'critique_missing' END) END AS failures,
  CASE WHEN report IS NOT NULL AND total_h2_count > numbered_chapter_count + 3
    THEN 'extra_headings: ' || total_h2_count || ' H2 for ' || numbered_chapter_count || ' chapters' ELSE '' END AS warnings
FROM {c_m}"""
C_GATE = """
SELECT *, n_fail = 0 AS passed, CASE WHEN n_fail = 0 THEN 'pass' WHEN n_fail <= 2 THEN 'soft_fail' ELSE 'hard_fail' END AS severity
FROM (SELECT *, CASE WHEN failures = '' THEN 0 ELSE len(string_split(failures, '; ')) END AS n_fail FROM {c_rules}) t"""
GATE = {"c_m": C_MEASURED, "c_rules": C_RULES, "c_gate": C_GATE}


def measured(v: Views):
    return g.measure(g.with_thresholds(v.v_reports))


def gated(v: Views):
    return g.check_documents(v.v_reports, require_critique=F.col("stage") == "final")


def whole(name: str):
    """A count that is always present, as BIGINT."""
    return F.coalesce(F.col(name), F.lit(-1)).cast("long").alias(name)


def _count_query(key: str, column: str, sql: str):
    @query(key, f"SELECT doc_key, coalesce(CAST({sql} AS BIGINT), -1) AS {column} FROM {{c_m}}", c_m=C_MEASURED)
    def plan(v):
        return measured(v).select("doc_key", whole(column))

    return plan


@query("g01_missing_report", """
SELECT doc_key, n_fail AS failures FROM {c_gate} WHERE report IS NULL""", **GATE)
def g01(v):
    return gated(v).where("report is null").select("doc_key", F.size("failures").cast("long").alias("failures"))


_count_query("g02_report_length", "report_chars", "report_chars")
_count_query("g04_citations", "report_url_count", "report_url_count")
_count_query("g05_missing_phrases", "unknown_phrase_count", "unknown_phrase_count")
_count_query("g06_chapters", "numbered_chapter_count", "numbered_chapter_count")
_count_query("g07_headings", "total_h2_count", "total_h2_count")
_count_query("g10_empty_fields", "metrics_null_count", "metrics_null_count")


@query("g03_language_tags", """
SELECT doc_key, CASE WHEN report IS NULL THEN -1 ELSE len(tags) END AS violations,
  CASE WHEN report IS NULL THEN '' ELSE array_to_string(list_slice(tags, 1, 5), ' ') END AS samples FROM {c_m}""",
       c_m=C_MEASURED)
def g03(v):
    return measured(v).select(
        "doc_key", F.when(F.col("report").isNotNull(), F.col("language_tag_violations")).otherwise(-1).cast("long").alias("violations"),
        F.coalesce(F.array_join("tag_samples", " "), F.lit("")).alias("samples"))


@query("g08_metrics_json", """
SELECT doc_key, CASE WHEN metrics_json IS NULL THEN 'missing' WHEN j IS NULL THEN 'invalid' WHEN is_object THEN 'object'
  ELSE 'other' END AS state FROM {c_m}""", c_m=C_MEASURED)
def g08(v):
    state = F.when(F.col("metrics_json").isNull(), "missing").when(~F.col("metrics_valid"), "invalid").when(
        F.col("fields").isNotNull(), "object").otherwise("other")
    return measured(v).select("doc_key", state.alias("state"))


@query("g09_required_keys", "SELECT doc_key, missing_keys FROM {c_m}", c_m=C_MEASURED)
def g09(v):
    return measured(v).select("doc_key", joined("missing_keys"))


@query("g11_recommendation", """
SELECT doc_key, recommendation, coalesce(recommendation NOT IN ('strong_buy', 'subscribe', 'cautious', 'avoid'), FALSE) AS bad
FROM {c_m}""", c_m=C_MEASURED)
def g11(v):
    bad = F.exists("failures", lambda f: f.startswith("metrics_bad_recommendation"))
    rows = g.check_rules(measured(v).withColumn("report", F.coalesce("report", F.lit(""))))
    return rows.select("doc_key", "recommendation", bad.alias("bad"))


@query("g12_research_notes", """
SELECT doc_key, coalesce(research_url_count, -1) AS research_url_count, coalesce(CAST(research_chars AS BIGINT), -1) AS research_chars
FROM {c_m}""", c_m=C_MEASURED)
def g12(v):
    return measured(v).select("doc_key", whole("research_url_count"), whole("research_chars"))


@query("g13_critique_required", """
SELECT doc_key, stage, contains(failures, 'critique_missing') AS critique_missing FROM {c_gate}""", **GATE)
def g13(v):
    return gated(v).select("doc_key", "stage", F.array_contains("failures", "critique_missing").alias("critique_missing"))


@query("g14_thresholds", """
SELECT stage, min_urls, max_unknown, max_nulls, min_chars, COUNT(*) AS documents FROM {c_m} GROUP BY ALL""", c_m=C_MEASURED)
def g14(v):
    return g.with_thresholds(v.v_reports).groupBy("stage", "min_urls", "max_unknown", "max_nulls", "min_chars").agg(
        F.count("*").alias("documents"))


@query("g15_verdict", "SELECT doc_key, stage, passed, severity, failures, warnings FROM {c_gate}", **GATE)
def g15(v):
    return gated(v).select("doc_key", "stage", "passed", "severity", joined("failures", "; "), joined("warnings", "; "))


@query("g16_cited_urls", f"""
SELECT doc_key, url, row_number() OVER (PARTITION BY doc_key ORDER BY MIN(pos)) - 1 AS pos FROM (SELECT doc_key, unnest(u) AS url, generate_subscripts(u, 1) AS pos FROM (
  SELECT doc_key, regexp_extract_all(report, '{_URL}') AS u FROM {{v_reports}}) a) b GROUP BY doc_key, url""")
def g16_urls(v):
    return g.report_urls(v.v_reports).select("doc_key", "url", F.col("pos").cast("long").alias("pos"))


@query("g16_verify_urls", f"""
SELECT d.doc_key, coalesce(n, 0) AS sampled, coalesce(ok, 0) AS ok,
  CASE WHEN n > 0 THEN round(ok / n, 3) ELSE CAST(0 AS DOUBLE) END AS ok_ratio,
  coalesce(n > 0 AND ok / n >= 0.5, FALSE) AS passed
FROM {{v_reports}} d LEFT JOIN (
  SELECT doc_key, COUNT(*) AS n, COUNT(*) FILTER (WHERE status >= 200 AND status < 400) AS ok FROM (
    SELECT DISTINCT doc_key, unnest(regexp_extract_all(report, '{_URL}')) AS url FROM {{v_reports}}) c
  LEFT JOIN {{v_url_status}} s ON s.url = c.url GROUP BY doc_key) t ON t.doc_key = d.doc_key""")
def g16(v):
    """All distinct URLs (a sample as large as any report), so that SQL can check the ratios."""
    rows = g.verify_urls(v.v_reports, v.v_url_status, sample_size=1_000_000)
    return rows.select("doc_key", "sampled", "ok", "ok_ratio", "passed")


@query("g16_sampled_urls")
def g16_sampled(v):
    rows = g.verify_urls(v.v_reports, v.v_url_status)
    return rows.select("doc_key", "sampled", "ok", "ok_ratio", "passed", joined("bad_examples", " "))


@query("g17_combined", """
SELECT doc_key, failures || CASE WHEN failures <> '' AND url_failure <> '' THEN '; ' ELSE '' END || url_failure AS failures,
  warnings, failures = '' AND url_failure = '' AS passed, coalesce(CAST(report_chars AS DOUBLE), CAST(-1 AS DOUBLE)) AS report_chars
FROM (SELECT *, CASE WHEN report IS NULL THEN 'report_missing' WHEN report_url_count = 0 THEN 'no_urls' ELSE '' END AS url_failure
  FROM {c_gate}) t""", **GATE)
def g17(v):
    first = gated(v).select("doc_key", F.lit(1).alias("seq"), "failures", "warnings", "metrics")
    urls = g.verify_urls(v.v_reports, v.v_url_status, min_ok_ratio=0.0)
    second = urls.select(
        "doc_key", F.lit(2).alias("seq"), F.array_compact(F.array("failure")).alias("failures"),
        F.array().cast("array<string>").alias("warnings"),
        F.create_map(F.lit("sampled"), F.col("sampled").cast("double")).alias("metrics"))
    rows = g.combine(first.unionByName(second))
    return rows.select("doc_key", joined("failures", "; "), joined("warnings", "; "), "passed",
                       F.coalesce(F.col("metrics")["report_chars"], F.lit(-1.0)).alias("report_chars"))


@query("g18_feedback", """
SELECT doc_key, CASE WHEN passed THEN '' ELSE 'Quality gate rejected the ' || stage || ' submission:' || chr(10) || fails
  || CASE WHEN warnings = '' THEN '' ELSE chr(10) || 'Warnings:' || chr(10) || '1. ' || warnings END END AS feedback
FROM (SELECT g.*, array_to_string(list_transform(string_split(failures, '; '), lambda x, i: CAST(i AS STRING) || '. ' || x), chr(10)) AS fails
  FROM {c_gate} g) t""", **GATE)
def g18(v):
    return gated(v).select("doc_key", g.feedback_text(F.col("stage")).alias("feedback"))


# --- contract checks --------------------------------------------------------------

C_URLS = f"""
SELECT doc_key, list_distinct(regexp_extract_all(report, '{_URL}')) AS cited,
  coalesce(regexp_extract_all(research_notes, '{_URL}'), []) AS logged FROM {{v_reports}} WHERE report IS NOT NULL"""


@query("r01_unlogged_urls", """
SELECT doc_key, len(cited) AS cited, array_to_string(list_sort(list_filter(cited, lambda u: NOT list_contains(logged, u))), ' ')
  AS unlogged FROM {c_u}""", c_u=C_URLS)
def r01(v):
    rows = ct.unlogged_urls(v.v_reports)
    return rows.select("doc_key", F.col("cited").cast("long").alias("cited"),
                       F.array_join(F.array_sort("unlogged"), " ").alias("unlogged"))


C_CHAPTERS = """
SELECT doc_key, i - 1 AS ordinal, split_part(piece, chr(10), 1) AS title,
  trim(substr(piece, length(split_part(piece, chr(10), 1)) + 1), chr(10)) AS body
FROM (SELECT doc_key, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_key, string_split(report, chr(10) || '## ') AS p FROM {v_reports}) a) b WHERE i > 1"""


@query("r02_chapters", "SELECT doc_key, ordinal, title, md5(body) AS digest FROM {c_c}", c_c=C_CHAPTERS)
def r02(v):
    rows = ct.chapters(v.v_reports)
    return rows.select("doc_key", F.col("ordinal").cast("long").alias("ordinal"), "title", F.md5("body").alias("digest"))


_TIERS = "(强烈关注|积极关注|谨慎关注|建议回避)"


@query("r03_tier_consistency", f"""
SELECT *, coalesce(opening_tier = closing_tier AND closing_tier = metric_tier, FALSE) AS consistent FROM (
  SELECT m.doc_key, nullif(o.tier, '') AS opening_tier, nullif(c.tier, '') AS closing_tier,
    CASE m.recommendation WHEN 'strong_buy' THEN '强烈关注' WHEN 'subscribe' THEN '积极关注' WHEN 'cautious' THEN '谨慎关注'
      WHEN 'avoid' THEN '建议回避' END AS metric_tier
  FROM {{c_m}} m
  LEFT JOIN (SELECT doc_key, regexp_extract(body, '{_TIERS}') AS tier FROM {{c_c}} WHERE title LIKE '一、%') o ON o.doc_key = m.doc_key
  LEFT JOIN (SELECT doc_key, regexp_extract(body, '{_TIERS}') AS tier FROM {{c_c}} WHERE title LIKE '八、%') c ON c.doc_key = m.doc_key
  WHERE m.report IS NOT NULL) t""", c_m=C_MEASURED, c_c=C_CHAPTERS)
def r03(v):
    return ct.tier_consistency(v.v_reports)


@query("r04_critique", """
SELECT doc_key, verdict, dimensions, score_sum, stated_total, required_fixes, next_action, score_sum = stated_total AS total_agrees,
  expected_action, next_action = expected_action AS action_agrees FROM (SELECT *, CASE WHEN stated_total >= 42 AND required_fixes = 0
    THEN 'publish_as_is' WHEN stated_total < 25 THEN 'redraft_from_scratch' ELSE 'revise' END AS expected_action
  FROM (SELECT doc_key, regexp_extract(critique, '\\*\\*(READY|NEEDS_REVISION|MAJOR_REWRITE)\\*\\*', 1) AS verdict,
    len(scores) AS dimensions, CAST(list_sum(list_transform(scores, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS score_sum,
    CAST(regexp_extract(critique, '\\*\\*Total: (\\d+) / 50\\*\\*', 1) AS BIGINT) AS stated_total,
    len(regexp_extract_all(split_part(split_part(critique, '## Required Fixes', 2), chr(10) || '## ', 1), '(?m)^\\d+\\. ')) AS required_fixes,
    regexp_extract(critique, '\\*\\*(publish_as_is|revise|redraft_from_scratch)\\*\\*', 1) AS next_action
  FROM (SELECT doc_key, critique, regexp_extract_all(critique, '(?m)^\\| [^|\\n]+ \\| (\\d)/5 \\|', 1) AS scores
    FROM {v_reports} WHERE critique IS NOT NULL) a) b) c""")
def r04(v):
    rows = ct.parse_critique(v.v_reports)
    longs = [F.col(c).cast("long").alias(c) for c in ("dimensions", "score_sum", "stated_total", "required_fixes")]
    return rows.select("doc_key", "verdict", *longs, "next_action", "total_agrees", "expected_action", "action_agrees")


@query("r05_research_log", f"""
SELECT doc_key, i - 1 AS ordinal, trim(split_part(piece, chr(10), 1), '" ') AS query,
  nullif(regexp_extract(piece, '{_URL}'), '') AS url, CASE WHEN regexp_matches(piece, '{_URL}') THEN 'url'
    WHEN contains(piece, 'no usable result') THEN 'no_result' ELSE 'unanswered' END AS outcome
FROM (SELECT doc_key, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_key, string_split(research_notes, chr(10) || '### Query: ') AS p FROM {{v_reports}}) a) b WHERE i > 1""")
def r05(v):
    rows = ct.research_queries(v.v_reports)
    return rows.select("doc_key", F.col("ordinal").cast("long").alias("ordinal"), "query", "url", "outcome")


@query("r05_research_coverage", """
SELECT doc_key, len(string_split(research_notes, chr(10) || '### Query: ')) - 1 AS queries,
  len(string_split(research_notes, chr(10) || '### Query: ')) - 1 >= 6 AS enough FROM {v_reports} WHERE research_notes IS NOT NULL""")
def r05_coverage(v):
    return ct.research_coverage(v.v_reports).withColumn("queries", F.col("queries").cast("long"))


_UNIT = "CASE WHEN NOT coalesce(try_cast(j->>'$.{k}' AS DOUBLE) BETWEEN 0 AND 1, FALSE) THEN '{k}_range' END"
_ONE_OF = "CASE WHEN NOT coalesce(j->>'$.{k}' IN ({v}), FALSE) THEN '{k}_value' END"


@query("r06_metric_rules", f"""
SELECT doc_key, concat_ws(',', CASE WHEN missing > 0 THEN 'fields_missing' END,
    {_ONE_OF.format(k='market', v="'US', 'HK', 'OTHER'")}, {_UNIT.format(k='confidence')},
    {_ONE_OF.format(k='signal', v="'bullish', 'bearish', 'neutral'")}, {_UNIT.format(k='risk_score')},
    CASE WHEN coalesce(j->>'$.sector' IN ('Unknown', ''), TRUE) THEN 'sector_value' END, {_UNIT.format(k='data_completeness')},
    {_ONE_OF.format(k='subscription_recommendation', v="'strong_buy', 'subscribe', 'cautious', 'avoid'")}) AS violations,
  missing AS missing_fields, CASE WHEN conf <= 0.4 THEN 'thin' WHEN conf >= 0.7 THEN 'strong' WHEN conf IS NOT NULL THEN 'medium' END
    AS confidence_band
FROM (SELECT *, try_cast(j->>'$.confidence' AS DOUBLE) AS conf, len(list_filter(['symbol', 'analysis_date', 'market', 'company_display_name',
    'confidence', 'predicted_price', 'signal', 'risk_score', 'sector', 'catalysts_count', 'risks_count', 'data_completeness',
    'subscription_recommendation'], lambda k: NOT list_contains(json_keys(j), k))) AS missing FROM {{c_m}} WHERE is_object) t""",
       c_m=C_MEASURED)
def r06(v):
    rows = ct.metric_rules(v.v_reports)
    return rows.select("doc_key", joined("violations"), F.col("missing_fields").cast("long").alias("missing_fields"),
                       "confidence_band")


def _lines(column: str, pattern: str) -> str:
    return f"len(list_filter(string_split({column}, chr(10)), lambda x: regexp_matches(x, '{pattern}')))"


@query("r07_line_counts", f"""
SELECT doc_key, {_lines('report', 'https?://')} AS url_lines, {_lines('report', _MISSING)} AS missing_phrase_lines,
  {_lines('report', '^## [一二三四五六七八]、')} AS chapter_lines, coalesce({_lines('research_notes', 'https?://')}, 0) AS research_url_lines
FROM {{v_reports}} WHERE report IS NOT NULL""")
def r07(v):
    rows = ct.line_counts(v.v_reports)
    return rows.select("doc_key", *[F.col(c).cast("long").alias(c) for c in rows.columns[1:]])


C_MARKS = """
SELECT doc_key, i, substr(line, 12) AS milestone, CAST(substr(line, 2, 2) AS BIGINT) * 3600 + CAST(substr(line, 5, 2) AS BIGINT) * 60
  + CAST(substr(line, 8, 2) AS BIGINT) AS second
FROM (SELECT doc_key, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (
  SELECT doc_key, list_filter(string_split(log, chr(10)), lambda l: regexp_matches(l, '^\\[\\d{{2}}:\\d{{2}}:\\d{{2}}\\] [^\\s]+$')) AS x
  FROM {v_progress}) a) b"""


@query("r08_progress_steps", """
SELECT doc_key, i AS ordinal, milestone, second,
  coalesce((second - LAG(second) OVER (PARTITION BY doc_key ORDER BY i) + 86400) % 86400, -1) AS gap_seconds FROM {c_x}""", c_x=C_MARKS)
def r08(v):
    rows = ct.progress_steps(v.v_progress)
    return rows.select("doc_key", F.col("ordinal").cast("long").alias("ordinal"), "milestone",
                       F.col("second").cast("long").alias("second"), whole("gap_seconds"))


@query("r08_missing_milestones", """
SELECT doc_key, array_to_string(list_filter(['inventory_complete', 'web_research_done', 'chapter_一_drafted', 'chapter_二_drafted',
  'chapter_三_drafted', 'chapter_四_drafted', 'chapter_五_drafted', 'chapter_六_drafted', 'chapter_七_drafted', 'chapter_八_drafted',
  'metrics_written', 'self_check_done'], lambda m: NOT contains(log, '] ' || m || chr(10))), ',') AS missing FROM {v_progress}""")
def r08_missing(v):
    return ct.missing_milestones(v.v_progress).select("doc_key", joined("missing"))


@query("r09_tone", """
SELECT doc_key, coalesce(len(regexp_extract_all(report, '(?i)guaranteed|must rise|must surge|risk-free')), 0) AS tone_hits FROM {v_reports}""")
def r09(v):
    return ct.tone_hits(v.v_reports).withColumn("tone_hits", F.col("tone_hits").cast("long"))


@query("r10_references", """
SELECT doc_key, len(e) AS entries, len(e) >= 6 AS enough, array_to_string(list_sort(list_filter(list_distinct(m),
  lambda x: NOT list_contains(e, x))), ',') AS dangling FROM (
  SELECT doc_key, regexp_extract_all(report, '(?m)^\\[(\\d+)\\] [^\\n]*https?://[^\\s]+[^\\n]*Accessed \\d{{4}}-\\d{{2}}-\\d{{2}}', 1) AS e,
    regexp_extract_all(report, '\\[(\\d+)\\]', 1) AS m FROM {v_reports} WHERE report IS NOT NULL) t""")
def r10(v):
    rows = ct.reference_check(v.v_reports)
    return rows.select("doc_key", F.col("entries").cast("long").alias("entries"), "enough",
                       F.array_join(F.array_sort("dangling"), ",").alias("dangling"))


# --- stage outcomes -----------------------------------------------------------------

C_OUTCOMES = """
SELECT a.run_date, a.symbol, attempts, duration_seconds, draft_gate, coalesce(report_chars > 0, FALSE) AS has_report,
  coalesce(report_chars > 0, FALSE) AND coalesce(final_gate, FALSE) AND coalesce(passed, TRUE) AS final_gate_passed,
  coalesce(report_chars > 0, FALSE) AND coalesce(metrics_fields > 0, FALSE) AS success,
  CASE WHEN report_chars IS NULL THEN 'no_report' END AS error
FROM (SELECT run_date, symbol, COUNT(*) AS attempts, CAST(SUM(duration_seconds) AS DOUBLE) AS duration_seconds,
    arg_max(gate_passed, attempt) FILTER (WHERE stage = 'drafter' AND success) AS draft_gate,
    arg_max(gate_passed, attempt) FILTER (WHERE stage = 'reviser' AND success) AS final_gate
  FROM {v_outcomes} GROUP BY run_date, symbol) a JOIN {v_artifacts} t ON t.run_date = a.run_date AND t.symbol = a.symbol"""


def outcomes_of(v: Views):
    checks = v.v_artifacts.select("run_date", "symbol", "passed")
    return oc.final_outcomes(v.v_outcomes, v.v_artifacts, checks)


@query("o01_final_outcome", """
SELECT CAST(run_date AS STRING) AS run_date, symbol, attempts, duration_seconds, draft_gate, final_gate_passed, success, error
FROM {c_o}""", c_o=C_OUTCOMES)
def o01(v):
    return outcomes_of(v).select(
        iso("run_date"), "symbol", "attempts", F.col("duration_seconds").cast("double").alias("duration_seconds"), "draft_gate",
        "final_gate_passed", "success", "error")


@query("o02_attempt_violations", """
SELECT CAST(run_date AS STRING) AS run_date, symbol, stage, attempt, broken FROM (SELECT *, concat_ws(',',
    CASE WHEN passed_before > 0 THEN 'after_pass' END, CASE WHEN failed_before > 0 THEN 'after_failure' END,
    CASE WHEN attempt > CASE stage WHEN 'reviewer' THEN 1 ELSE 2 END THEN 'beyond_max' END) AS broken
  FROM (SELECT *, SUM(CASE WHEN gate_passed THEN 1 ELSE 0 END) OVER w AS passed_before,
      SUM(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS failed_before FROM {v_outcomes}
    WINDOW w AS (PARTITION BY run_date, symbol, stage ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a) b
WHERE broken <> ''""")
def o02(v):
    return oc.attempt_violations(v.v_outcomes).select(iso("run_date"), "symbol", "stage", "attempt", joined("broken"))


@query("o03_run_record", """
SELECT CAST(a.run_date AS STRING) AS run_date, a.symbol, outcomes, artifact_keys, coalesce(notes_chars, 0) AS research_notes_chars,
  coalesce(critique_chars, 0) AS critique_chars FROM (SELECT run_date, symbol, string_agg(stage || '#' || attempt || '='
      || CASE WHEN success THEN 'ok' ELSE error END, ';' ORDER BY CASE stage WHEN 'drafter' THEN 0 WHEN 'reviewer' THEN 1 ELSE 2 END, attempt)
    AS outcomes FROM {v_outcomes} GROUP BY run_date, symbol) a
JOIN {v_artifacts} t ON t.run_date = a.run_date AND t.symbol = a.symbol""")
def o03(v):
    rows = oc.run_records(v.v_outcomes, v.v_artifacts)
    text = F.transform("stage_outcomes", lambda o: F.concat(
        o["stage"], F.lit("#"), o["attempt"].cast("string"), F.lit("="), F.when(o["success"], "ok").otherwise(o["error"])))
    return rows.select(iso("run_date"), "symbol", F.array_join(text, ";").alias("outcomes"), "artifact_keys",
                       "research_notes_chars", "critique_chars")


@query("o03_ranked_outcomes", """
SELECT CAST(run_date AS STRING) AS run_date, symbol, stage, attempt, success, ROW_NUMBER() OVER (PARTITION BY run_date, symbol
    ORDER BY CASE stage WHEN 'drafter' THEN 0 WHEN 'reviewer' THEN 1 ELSE 2 END, attempt) AS rank FROM {v_outcomes}""")
def o03_long(v):
    return oc.ranked_outcomes(v.v_outcomes).select(iso("run_date"), "symbol", "stage", "attempt", "success", "rank")


@query("o03_record_heads", """
SELECT CAST(run_date AS STRING) AS run_date, symbol, first_stage, first_attempt, CASE WHEN n > 1 THEN n - 1 ELSE 0 END AS more_outcomes FROM (
  SELECT run_date, symbol, COUNT(*) AS n, min_by(stage, place) AS first_stage, min_by(attempt, place) AS first_attempt FROM (
    SELECT *, CASE stage WHEN 'drafter' THEN 0 WHEN 'reviewer' THEN 1 ELSE 2 END * 1000000 + attempt AS place FROM {v_outcomes}) p
  GROUP BY run_date, symbol) t""")
def o03_heads(v):
    first = F.get("stage_outcomes", F.lit(0))
    rows = oc.run_records(v.v_outcomes, v.v_artifacts, nested=1)
    return rows.select(iso("run_date"), "symbol", first["stage"].alias("first_stage"), first["attempt"].alias("first_attempt"), "more_outcomes")


@query("o04_run_summary", """
SELECT CAST(run_date AS STRING) AS run_date, COUNT(*) AS runs, COUNT(*) FILTER (WHERE success) AS success_count,
  COUNT(*) FILTER (WHERE NOT success) AS failure_count, COUNT(*) FILTER (WHERE final_gate_passed) AS final_gate_passed
FROM {c_o} GROUP BY run_date""", c_o=C_OUTCOMES)
def o04(v):
    return oc.run_summary(outcomes_of(v)).withColumn("run_date", F.col("run_date").cast("string"))


@query("o05_failed_snapshots", """
SELECT CAST(f.run_date AS STRING) AS run_date, f.symbol, bucket || '/' || file_name AS artifact_key,
  md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || chr(10) || '[TRUNCATED — original '
    || CAST(length(text) AS STRING) || ' chars]' ELSE text END) AS digest
FROM {v_files} f JOIN {c_o} o ON o.run_date = f.run_date AND o.symbol = f.symbol AND NOT o.success
WHERE file_name <> 'prompt.md'""", c_o=C_OUTCOMES)
def o05(v):
    rows = oc.failed_run_snapshots(outcomes_of(v), v.v_files, 2000)
    return rows.select(iso("run_date"), "symbol", "artifact_key", F.md5("text").alias("digest"))
