"""Values that results depend on, stated as plain data.

Everything here is a FIXED VALUE: word lists, patterns, thresholds, tags, key
layouts and plan rows that have to equal the published contract of the
research pipeline for results to agree.  No logic lives in this module.
"""

# --- fixed values: document gate thresholds per stage ----------------------
GATE_THRESHOLDS = [
    # stage, min_urls, max_unknown, required_chapters, max_nulls, min_research_urls, min_chars
    ("draft", 6, 8, 8, 5, 6, 3000),
    ("final", 7, 5, 8, 3, 7, 3500),
]

# --- fixed values: patterns (Java syntax; (?U) gives Unicode \s and \w) ----
HALF_WIDTH_TAG = r"(?iu)\((?:English|EN|中文|ZH|中|英|英文)\)"
FULL_WIDTH_TAG = r"(?iu)（(?:中文|英文|EN|ZH|中|英|English)）"
URL = r"(?U)https?://[^\s\)\]\>\"']+"
MISSING_PHRASE = r"(?iu)Not available|N/A|Unknown|无法评估|暂无数据|数据缺失|信息缺失|未提供"
NUMBERED_CHAPTER = r"(?mdU)^##\s+[一二三四五六七八九十]+、"
ANY_H2 = r"(?mdU)^##\s+\S"
REPORT_KEY = r"^reports/(\d{4}-\d{2}-\d{2})/([^/]+)_report\.md$"
UNSAFE_SLUG_CHAR = r"[^A-Za-z0-9._-]"

# --- fixed values: metrics document -----------------------------------------
REQUIRED_METRIC_KEYS = [
    "symbol",
    "analysis_date",
    "subscription_recommendation",
    "confidence",
    "signal",
    "risk_score",
]
METRIC_SCHEMA_KEYS = [
    "symbol",
    "analysis_date",
    "market",
    "company_display_name",
    "confidence",
    "predicted_price",
    "signal",
    "risk_score",
    "sector",
    "catalysts_count",
    "risks_count",
    "data_completeness",
    "subscription_recommendation",
]
RECOMMENDATIONS = ["strong_buy", "subscribe", "cautious", "avoid"]
SIGNALS = ["bullish", "bearish", "neutral"]
MARKETS = ["US", "HK", "OTHER"]
EMPTY_MARKERS = ["Unknown", ""]
TIER_BY_RECOMMENDATION = [
    ("strong_buy", "强烈关注"),
    ("subscribe", "积极关注"),
    ("cautious", "谨慎关注"),
    ("avoid", "建议回避"),
]
TIER_PATTERN = "强烈关注|积极关注|谨慎关注|建议回避"

# --- fixed values: critique, research log, progress log, tone ---------------
CRITIQUE_VERDICTS = ["READY", "NEEDS_REVISION", "MAJOR_REWRITE"]
CRITIQUE_ACTIONS = ["publish_as_is", "revise", "redraft_from_scratch"]
PUBLISH_FLOOR = 42
REDRAFT_CEILING = 25
PROGRESS_MILESTONES = [
    "inventory_complete",
    "web_research_done",
    "chapter_一_drafted",
    "chapter_二_drafted",
    "chapter_三_drafted",
    "chapter_四_drafted",
    "chapter_五_drafted",
    "chapter_六_drafted",
    "chapter_七_drafted",
    "chapter_八_drafted",
    "metrics_written",
    "self_check_done",
]
BANNED_TONE = r"(?iu)guaranteed|must rise|must surge|risk-free"
MIN_RESEARCH_QUERIES = 6
MIN_REFERENCE_ENTRIES = 6

# --- fixed values: themed partitions (name, title, chapters, source keys) ---
PARTITION_PLAN = [
    ("ipo.json", "Listing terms and matched regulatory filings",
     "二、IPO Snapshot · 八、Synthesis",
     ["ipo_data", "ipo_regulatory_context", "resolved_cik"]),
    ("profile.json", "Who the company is",
     "三、Fundamentals · 五、Ownership & Management",
     ["company_profile", "company_notes"]),
    ("financials.json", "Statements, metrics and ratios",
     "四、Financial Health · 八、Synthesis",
     ["financials", "fundamental_extras"]),
    ("ownership.json", "Managers, free float and insiders' trades",
     "五、Ownership & Management",
     ["ownership_governance"]),
    ("sell_side.json", "What analysts expect",
     "三、Fundamentals · 六、Bull Case · 八、Synthesis",
     ["sell_side"]),
    ("peers.json", "Peers",
     "三、Fundamentals · 八、Synthesis · value",
     ["comparables"]),
    ("news.json", "News and the company's own releases",
     "六、Bull Case · 七、Bear Case",
     ["news_context"]),
    ("filings.json", "Filings of the last two years",
     "二、IPO Snapshot · 七、Bear Case · control",
     ["sec_filings_recent"]),
    ("market.json", "Daily prices beside the benchmark",
     "八、Synthesis · first day",
     ["market_context"]),
    ("sector.json", "How sector and industry did",
     "三、Fundamentals · 八、Synthesis",
     ["sector_industry_context"]),
    ("macro.json", "Economy and markets on the day",
     "三、Fundamentals · cycle · 八、Synthesis",
     ["global_market_context"]),
    ("fundraising.json", "Money raised before the listing",
     "四、Financial Health · cash",
     ["fundraising"]),
    ("fetch_errors.json", "Requests that gave no data",
     "Gaps to close from other sources",
     ["fetch_errors"]),
]

# --- fixed values: lineage tags, in the order they are appended --------------
SOURCE_TAGS = [
    "fmp_ipo_calendar_row",
    "fmp_profile",
    "fmp_company_notes",
    "fmp_fundraising",
    "fmp_sector_industry_history",
    "fmp_financial_statements",
    "fmp_historical_eod",
    "fmp_quote",
    "fmp_news",
    "fmp_stock_peers",
    "fmp_ownership_governance",
    "fmp_sell_side",
    "fmp_fundamental_extras",
    "fmp_sec_filings",
    "fmp_ipo_regulatory_lists",
    "fmp_global_market_prefetch",
]

# --- fixed values: list limits and windows -----------------------------------
REGULATORY_MAX_ROWS = 60
EOD_MAX_ROWS = 72
SERIES_TAIL = 40
FILINGS_DAYS = 730
FILINGS_LIMIT = 40
PRICE_WINDOW_DAYS = 800
PRICE_WINDOW_NO_DATE_DAYS = 420
PRICE_WINDOW_FUTURE_DAYS = 120
BENCHMARK_SYMBOL = "SPY"
MACRO_CALENDAR_DAYS = 21
INDICATORS = ["GDP", "realGDP", "inflationRate", "unemploymentRate"]
INDEX_SYMBOLS = ["^GSPC", "^VIX", "^IXIC"]
# part of the macro bundle -> (which end is kept, how many rows)
MACRO_TRIM = {
    "treasury_rates": ("tail", 30),
    "economic_indicators": ("tail", 14),
    "economic_calendar": ("head", 50),
    "sector_performance_snapshot": ("head", 60),
    "industry_performance_snapshot": ("head", 80),
    "sector_pe_snapshot": ("head", 40),
    "industry_pe_snapshot": ("head", 80),
}

# --- fixed values: forecast evaluation ---------------------------------------
FORECAST_OFFSET_DAYS = 30
PRICE_TOLERANCE_DAYS = 5
DEVIATION_THRESHOLD = 0.15
MIN_SAMPLES = 5
FAILURE_RATE_LIMIT = 0.5
NO_ACTION_PASS_RATE = 0.8
STREAK_LENGTH = 3

# --- fixed values: failed-run snapshots --------------------------------------
SNAPSHOT_FILES = [
    "report.md",
    "metrics.json",
    "research_notes.md",
    "critique.md",
    "_progress.log",
    "INDEX.md",
]
SNAPSHOT_MAX_CHARS = 262144

# --- fixed values: object key layout (family, prefix, suffix after symbol) ----
KEY_FAMILIES = [
    ("report", "reports/", "_report.md"),
    ("metrics", "metrics/", "_metrics.json"),
    ("raw_data", "raw_data/", "_raw_data.json"),
    ("state", "state/", "_state.json"),
    ("research_notes", "research_notes/", "_research_notes.md"),
    ("critique", "critique/", "_critique.md"),
    ("quality_gate", "quality_gate/", "_gate.json"),
    ("debug", "debug/", "/"),
]
SHARED_BUNDLE_PREFIX = "raw_data/_shared/"
SHARED_BUNDLE_NAME = "fmp_prefetch_bundle.json"
DEVIATION_HISTORY_KEY = "state/evolution/deviation_history.json"
PROMPT_VERSIONS_PREFIX = "state/evolution/prompt_versions/"
PROMPT_VERSION_SUFFIX = ".md"

# --- fixed values: publishing -------------------------------------------------
PUBLISH_LIMIT = 50
PAGE_SIZE = 20
REPORT_TITLE_SUFFIX = " · IPO 研报"

# --- fixed values: correction texts (printf formats) ---------------------------
CORRECTION_TRIGGER = "high_failure_rate"
RECOMMENDATION_FORMAT = (
    "Adjust for %s bias. Average deviation: %.2f%%. Failure rate: %.1f%% (%d/%d samples)."
)
CORRECTION_BLOCK_FORMAT = (
    "\n\n---\n"
    "## Auto-Correction Applied (%s)\n\n"
    "**Trigger:** %s\n"
    "**Bias Direction:** %s\n"
    "**Recommendation:** %s\n"
    "\n"
    "Adjust your confidence scoring and price predictions to account for "
    "systematic %s bias observed in "
    "%.0f%% of recent predictions.\n"
)

# --- fixed values: characters that count as white space -------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
