import json

from pyspark.sql import functions as F

from tests.helpers import plan_of, rows
from tickerloom import fixed_values as fv
from tickerloom.operators import contracts as ct
from tickerloom.operators import gate as g

HEADS = ["一、核心摘要 (Executive Summary)", "二、速览 (IPO Snapshot)", "三、基本面 (Fundamental Analysis)", "四、财务 (Financial Health)",
         "五、股权 (Ownership)", "六、正向 (The Bull Case)", "七、反向 (The Bear Case)", "八、综合 (Synthesis)"]
GOOD_METRICS = {
    "symbol": "QUIX", "analysis_date": "2026-01-15", "market": "US", "company_display_name": "Quix", "confidence": 0.65,
    "predicted_price": 42.5, "signal": "bullish", "risk_score": 0.35, "sector": "Tech", "catalysts_count": 4, "risks_count": 5,
    "data_completeness": 0.7, "subscription_recommendation": "subscribe"}


def report(chapters=8, urls=8, extra="", tiers=("积极关注", "积极关注")):
    parts = ["# 《Quix》\n"]
    for i, h in enumerate(HEADS[:chapters]):
        tier = tiers[0] if i == 0 else tiers[1] if i == 7 else ""
        parts.append(f"## {h}\n\n{tier} {'text ' * 100}[1]\n")
    refs = "".join(f"[{i}] *Source* SEC EDGAR https://www.sec.gov/a/{i} Accessed 2026-01-01\n" for i in range(1, urls + 1))
    return "\n".join(parts) + extra + "\n## 资料来源 (References)\n\n" + refs + "\n## 免责声明 (Disclaimer)\n\nNot advice.\n"


def notes(n=8):
    return "# Research Notes\n" + "".join(
        f'\n### Query: "q {i}"\n- Date: 2026-01-01\n- URL: https://www.sec.gov/a/{i}\n' for i in range(1, n + 1))


COLUMNS = "doc_key STRING, stage STRING, report STRING, metrics_json STRING, research_notes STRING, critique STRING"


def docs(spark, **cases):
    good = {"stage": "final", "report": report(), "metrics_json": json.dumps(GOOD_METRICS), "research_notes": notes(), "critique": "c"}
    data = [(k, *[{**good, **case}[c] for c in ("stage", "report", "metrics_json", "research_notes", "critique")])
            for k, case in cases.items()]
    return spark.createDataFrame(data, COLUMNS)


def check(spark, **cases):
    out = g.check_documents(docs(spark, **cases), require_critique=F.col("stage") == "final")
    return {r["doc_key"]: r for r in out.collect()}


def rules(row):
    return [f.split(":")[0] for f in row["failures"]]


def test_each_rule(spark):
    out = check(
        spark,
        good={}, no_report={"report": None, "metrics_json": None}, half={"report": report(extra="\n## Overview (English)\n(中文)\n")},
        full={"report": report(extra="\n概览（中文）\n")}, no_urls={"report": report(urls=0)}, few_final={"report": report(urls=6)},
        few_draft={"report": report(urls=6), "stage": "draft"}, missing={"report": report(extra="Not available. " * 12)},
        three={"report": report(chapters=3)}, headings={"report": report(extra="\n## x\n## y\n## z\n")},
        no_metrics={"metrics_json": None}, bad_json={"metrics_json": '{"a": 1} trailing'}, empty={"metrics_json": "{}"},
        listed={"metrics_json": "[]"}, moon={"metrics_json": json.dumps({**GOOD_METRICS, "subscription_recommendation": "moon_shot"})},
        null_rec={"metrics_json": json.dumps({**GOOD_METRICS, "subscription_recommendation": None})},
        nulls={"metrics_json": json.dumps({**GOOD_METRICS, "sector": "Unknown", "market": "", "risks_count": None, "predicted_price": None})},
        no_notes={"research_notes": None}, few_notes={"research_notes": notes(3)}, no_critique={"critique": None},
        draft_no_critique={"critique": None, "stage": "draft"})
    want = {
        "good": [], "no_report": ["report_missing"], "half": ["language_tags"], "full": ["language_tags"], "no_urls": ["too_few_citations"],
        "few_final": ["too_few_citations"], "few_draft": [], "missing": ["missing_info_phrases"],
        "three": ["report_too_short", "too_few_chapters"], "headings": [], "no_metrics": ["metrics_missing"],
        "bad_json": ["metrics_invalid_json"], "empty": ["metrics_keys_missing"], "listed": [], "moon": ["metrics_bad_recommendation"],
        "null_rec": [], "nulls": ["metrics_empty_fields"], "no_notes": ["research_notes_missing"], "few_notes": ["too_few_research_urls"],
        "no_critique": ["critique_missing"], "draft_no_critique": []}
    assert {k: rules(r) for k, r in out.items()} == want
    assert out["half"]["failures"] == ["language_tags: 2 found, e.g. (English) (中文)"]
    assert out["empty"]["failures"] == ["metrics_keys_missing: " + ",".join(sorted(fv.REQUIRED_METRIC_KEYS))]
    assert [w.split(":")[0] for w in out["headings"]["warnings"]] == ["extra_headings"]
    assert out["no_report"]["metrics"] == {} and "metrics_null_count" not in out["no_metrics"]["metrics"]
    assert (out["good"]["severity"], out["three"]["severity"], out["good"]["passed"]) == ("pass", "soft_fail", True)


def test_many_failures_are_hard(spark):
    row = check(spark, bad={"report": "short", "metrics_json": None, "research_notes": None})["bad"]
    assert row["severity"] == "hard_fail" and len(row["failures"]) > 2


def test_unicode_white_space_ends_a_url(spark):
    row = check(spark, x={"report": report(extra="\nhttps://a.b/c　https://a.b/d\n")})["x"]
    assert row["metrics"]["report_url_count"] == 10.0


def test_gate_needs_no_shuffle(spark):
    plan = plan_of(g.check_documents(docs(spark, good={})))
    assert "hashpartitioning" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_url_verification(spark):
    table = docs(spark, ok={}, none={"report": report(urls=0)}, gone={"report": None})
    good = spark.createDataFrame([(f"https://www.sec.gov/a/{i}", 200 if i <= 4 else 404) for i in range(1, 8)], "url STRING, status INT")
    out = {r["doc_key"]: r for r in g.verify_urls(table, good, sample_size=100).collect()}
    assert (out["ok"]["sampled"], out["ok"]["ok"], out["ok"]["ok_ratio"], out["ok"]["passed"]) == (8, 4, 0.5, True)
    assert out["none"]["failure"] == "no_urls" and out["gone"]["failure"] == "report_missing"
    worse = {r["doc_key"]: r for r in g.verify_urls(table, good.where("status = 200 and url not like '%4'"), sample_size=100).collect()}
    assert worse["ok"]["passed"] is False and len(worse["ok"]["bad_examples"]) == 3
    one = g.verify_urls(table, good, sample_size=5)
    assert rows(one, "doc_key", "sampled", "ok") == rows(g.verify_urls(table, good, sample_size=5), "doc_key", "sampled", "ok")


def test_combine_and_feedback(spark):
    data = [("d", 2, ["b"], ["w"], {"x": 2.0}), ("d", 1, ["a"], [], {"x": 1.0, "y": 5.0}), ("e", 1, [], [], {})]
    out = {r["doc_key"]: r for r in g.combine(spark.createDataFrame(
        data, "doc_key STRING, seq INT, failures ARRAY<STRING>, warnings ARRAY<STRING>, metrics MAP<STRING, DOUBLE>")).collect()}
    assert out["d"]["failures"] == ["a", "b"] and out["d"]["metrics"] == {"x": 2.0, "y": 5.0} and out["d"]["passed"] is False
    assert out["e"]["passed"] is True
    texts = spark.createDataFrame([(["a", "b"], ["w"], False), ([], [], True)],
                                  "failures ARRAY<STRING>, warnings ARRAY<STRING>, passed BOOLEAN")
    got = [r["t"] for r in texts.select(g.feedback_text(F.lit("draft")).alias("t")).collect()]
    assert got == ["Quality gate rejected the draft submission:\n1. a\n2. b\nWarnings:\n1. w", ""]


def test_chapters_and_tiers(spark):
    table = docs(spark, same={}, differs={"report": report(tiers=("积极关注", "建议回避"))})
    first = ct.chapters(table).where("doc_key = 'same'").orderBy("ordinal").collect()
    assert [r["title"] for r in first][:2] == HEADS[:2] and len(first) == 10
    assert first[-1]["body"] == "Not advice."
    assert rows(ct.tier_consistency(table), "doc_key", "consistent") == [("differs", False), ("same", True)]


def test_logs_and_references(spark):
    table = docs(spark, x={"report": report(urls=7, extra="\nSee [9].\n"),
                           "research_notes": notes(3) + '\n### Query: "none"\n- Searched: no usable result\n'})
    queries = ct.research_queries(table).orderBy("ordinal").collect()
    assert [r["outcome"] for r in queries] == ["url"] * 3 + ["no_result"] and queries[0]["query"] == "q 1"
    assert ct.research_coverage(table).first()["enough"] is False
    refs = ct.reference_check(table).first()
    assert (refs["entries"], refs["enough"], refs["dangling"]) == (7, True, ["9"])
    assert ct.unlogged_urls(table).first()["unlogged"] == [f"https://www.sec.gov/a/{i}" for i in range(4, 8)]
    lines = docs(spark, x={"report": "https://a.b https://c.d\nN/A n/a\n## 一、x\n"})
    assert rows(ct.line_counts(lines), "url_lines", "missing_phrase_lines", "chapter_lines") == [(1, 1, 1)]


def test_critique(spark):
    text = ("## Overall Verdict\n\n**NEEDS_REVISION**\n\n| Dimension | Score (0-5) | Comment |\n|---|---|---|\n| A b | 4/5 | x |\n| C | 3/5 | y |\n"
            "\n**Total: 7 / 50**\n\n## Required Fixes (must)\n\n1. one\n2. two\n\n## Suggested Improvements\n\n1. maybe\n\n"
            "## Recommended Next Action\n\n**revise**\n")
    row = ct.parse_critique(docs(spark, x={"critique": text})).first()
    assert (row["verdict"], row["dimensions"], row["score_sum"], row["stated_total"], row["required_fixes"]) == ("NEEDS_REVISION", 2, 7, 7, 2)
    assert row["total_agrees"] and row["expected_action"] == "redraft_from_scratch" and row["action_agrees"] is False


def test_metric_rules_progress_and_tone(spark):
    bad = {**GOOD_METRICS, "confidence": 1.4, "signal": "sideways", "sector": "Unknown"}
    del bad["market"]
    out = {r["doc_key"]: r for r in ct.metric_rules(docs(spark, good={}, bad={"metrics_json": json.dumps(bad)})).collect()}
    assert out["good"]["violations"] == [] and out["good"]["confidence_band"] == "medium"
    assert out["bad"]["violations"] == ["fields_missing", "market_value", "confidence_range", "signal_value", "sector_value"]
    log = spark.createDataFrame([("d", "[23:59:50] inventory_complete\nnoise\n[00:00:20] web_research_done\n")], "doc_key STRING, log STRING")
    assert rows(ct.progress_steps(log), "ordinal", "gap_seconds") == [(1, None), (2, 30)]
    assert ct.missing_milestones(log).first()["missing"] == fv.PROGRESS_MILESTONES[2:]
    tone = docs(spark, x={"report": "Guaranteed and RISK-FREE; it must rise"})
    assert ct.tone_hits(tone).first()["tone_hits"] == 3


