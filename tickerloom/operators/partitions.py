"""Themed partitions of a research record and their availability catalog.

All of it is computed inside the record's own row: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom import fixed_values as fv
from tickerloom.functions.collections import array_populated_sql, variant_populated_sql

JSON_OPTIONS = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}

# partition -> [(metric, kind)], kind: rows (list length) | flag (populated or not) | text (value or missing)
# The metric is also the path of the value inside the record.
SUMMARY_PLAN = {
    "ipo.json": [
        ("ipo_data.date", "text"), ("ipo_data.exchange", "text"), ("ipo_data.priceRange", "text"),
        ("ipo_data.shares", "text"), ("ipo_data.marketCap", "text"), ("ipo_data.company", "text"),
        ("ipo_regulatory_context.disclosure_filings_matched", "rows"),
        ("ipo_regulatory_context.prospectus_entries_matched", "rows"),
        ("resolved_cik", "text"),
    ],
    "profile.json": [
        ("company_profile.companyName", "text"), ("company_profile.industry", "text"),
        ("company_profile.sector", "text"), ("company_profile.fullTimeEmployees", "text"),
        ("company_profile.ceo", "text"), ("company_profile.website", "text"),
        ("company_profile.description", "text"), ("company_notes", "rows"),
    ],
    "financials.json": [
        ("financials.income_statement_annual", "rows"), ("financials.income_statement_quarter", "rows"),
        ("financials.balance_sheet_annual", "rows"), ("financials.cash_flow_annual", "rows"),
        ("financials.key_metrics_annual", "rows"), ("financials.ratios_annual", "rows"),
        ("financials.enterprise_values_annual", "rows"), ("financials.key_metrics_ttm", "flag"),
        ("financials.ratios_ttm", "flag"), ("fundamental_extras.financial_scores", "flag"),
        ("fundamental_extras.revenue_product_segmentation", "flag"),
        ("fundamental_extras.revenue_geographic_segmentation", "flag"),
    ],
    "ownership.json": [
        ("ownership_governance.key_executives", "rows"), ("ownership_governance.shares_float", "flag"),
        ("ownership_governance.insider_trading_statistics", "flag"),
        ("ownership_governance.insider_trades_search", "rows"),
    ],
    "sell_side.json": [
        ("sell_side.analyst_estimates_annual", "rows"), ("sell_side.price_target_summary", "flag"),
        ("sell_side.price_target_consensus", "flag"), ("sell_side.ratings_snapshot", "flag"),
    ],
    "peers.json": [("comparables.stock_peers", "rows")],
    "news.json": [("news_context.stock_news", "rows"), ("news_context.press_releases", "rows")],
    "filings.json": [
        ("sec_filings_recent.filings", "rows"), ("sec_filings_recent.window_from", "text"),
        ("sec_filings_recent.window_to", "text"),
    ],
    "market.json": [
        ("market_context.company_eod_recent", "rows"), ("market_context.benchmark_eod_recent", "rows"),
        ("market_context.quote", "flag"),
    ],
    "sector.json": [
        ("sector_industry_context.identifiers.sector", "text"),
        ("sector_industry_context.identifiers.industry", "text"),
        ("sector_industry_context.historical_sector_performance", "rows"),
        ("sector_industry_context.historical_industry_performance", "rows"),
    ],
    "macro.json": [
        ("global_market_context.prefetch_as_of", "text"),
        ("global_market_context.treasury_rates_tail", "rows"),
        ("global_market_context.economic_calendar", "rows"),
        ("global_market_context.sector_performance_snapshot", "rows"),
        ("global_market_context.industry_performance_snapshot", "rows"),
        ("global_market_context.sector_pe_snapshot", "rows"),
        ("global_market_context.industry_pe_snapshot", "rows"),
        ("global_market_context.etf_sector_weightings_spy", "rows"),
        ("global_market_context.major_index_batch_quotes", "rows"),
        ("global_market_context.market_risk_premium", "flag"),
    ],
    "fundraising.json": [("fundraising", "rows")],
    "fetch_errors.json": [("fetch_errors", "rows")],
}


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path, or None when the record has no such field."""
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return current


def populated_sql(records: DataFrame, path: str) -> str:
    """SQL test: not null and not an empty list or object; sections with fields count as populated."""
    kind = field_type(records.schema, path)
    if kind is None:
        return "false"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return array_populated_sql(path)
    if isinstance(kind, T.VariantType):
        return variant_populated_sql(path)
    return f"{path} IS NOT NULL"


def split_record(records: DataFrame) -> DataFrame:
    """All themed payloads of every record as JSON text, empty ones included."""
    meta = F.struct("symbol", "timestamp", "data_sources").alias("_meta")
    parts = [
        F.struct(
            F.lit(i).alias("part_no"),
            F.lit(name).alias("partition"),
            F.to_json(F.struct(meta, *[F.col(k) for k in keys]), JSON_OPTIONS).alias("payload"),
        )
        for i, (name, _, _, keys) in enumerate(fv.PARTITION_PLAN, 1)
    ]
    return records.select("symbol", F.inline(F.array(*parts)))


def _status_sql(records: DataFrame, keys: list[str]) -> str:
    filled = " + ".join(f"CAST({populated_sql(records, k)} AS INT)" for k in keys)
    return f"CASE {filled} WHEN 0 THEN 'empty' WHEN {len(keys)} THEN 'full' ELSE 'partial' END"


def _inline(parts: list[str]) -> Column:
    """One output row per struct, built from SQL text (far fewer driver calls than columns)."""
    return F.expr(f"inline(array({', '.join(parts)}))")


def availability(records: DataFrame) -> DataFrame:
    """empty / partial / full per themed partition."""
    parts = [
        f"named_struct('part_no', {i}, 'partition', '{name}', 'status', {_status_sql(records, keys)})"
        for i, (name, _, _, keys) in enumerate(fv.PARTITION_PLAN, 1)
    ]
    return records.select("symbol", _inline(parts))


def _metric_sql(records: DataFrame, path: str, kind: str) -> str:
    """Struct of one metric: name, kind, value, status and a short detail text."""
    filled = populated_sql(records, path)
    known = field_type(records.schema, path) is not None
    value = f"CAST(greatest(coalesce(size({path}), 0), 0) AS BIGINT)" if kind == "rows" and known else f"CAST({filled} AS BIGINT)"
    text = f"CAST({path} AS STRING)"
    short = f"CASE WHEN length({text}) > 80 THEN concat(left({text}, 77), '...') ELSE {text} END"
    detail = short if kind == "text" and known else "CAST(NULL AS STRING)"
    return (f"named_struct('metric', '{path}', 'kind', '{kind}', 'value', {value}, "
            f"'status', IF({filled}, 'populated', 'missing'), 'detail', {detail})")


def _metrics_sql(records: DataFrame, name: str) -> str:
    return f"array({', '.join(_metric_sql(records, path, kind) for path, kind in SUMMARY_PLAN[name])})"


def payload_metrics(records: DataFrame) -> DataFrame:
    """Long table of row counts and populated / missing marks per partition."""
    parts = [
        f"named_struct('part_no', {i}, 'partition', '{name}', 'm', {_metrics_sql(records, name)})"
        for i, (name, _, _, _) in enumerate(fv.PARTITION_PLAN, 1)
    ]
    return records.select("symbol", _inline(parts)).select("symbol", "part_no", "partition", F.inline("m"))


def _summary_sql(records: DataFrame, name: str) -> str:
    """Bullet list of a partition's metrics."""
    shown = "CASE WHEN m.status = 'missing' THEN 'missing' WHEN m.kind = 'rows' THEN CAST(m.value AS STRING) ELSE coalesce(m.detail, m.status) END"
    return f"array_join(transform({_metrics_sql(records, name)}, m -> concat('- ', m.metric, ': ', {shown})), chr(10))"


def error_samples(records: DataFrame, samples: int = 5, width: int = 80) -> DataFrame:
    """Number of failed steps and the first few of them, messages cut to ``width``."""
    lines = F.transform(
        F.slice("fetch_errors", 1, samples),
        lambda e: F.concat(e["step"], F.lit(": "), F.left(e["error"], F.lit(width))),
    )
    return records.select("symbol", F.size("fetch_errors").alias("errors"), lines.alias("samples"))


def _catalog_sql(records: DataFrame) -> list[str]:
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    return [
        f"named_struct('part_no', {i}, 'partition', {quoted(name)}, 'title', {quoted(title)}, 'chapters', {quoted(chapters)}, "
        f"'status', {_status_sql(records, keys)}, 'summary', {_summary_sql(records, name)})"
        for i, (name, title, chapters, keys) in enumerate(fv.PARTITION_PLAN, 1)
    ]


def build_catalog(records: DataFrame) -> DataFrame:
    """Catalog rows in plan order: chapters served, availability and a summary text."""
    return records.select("symbol", "timestamp", _inline(_catalog_sql(records)))


def render_catalog(records: DataFrame) -> DataFrame:
    """The catalog of each record as one Markdown text."""
    parts = F.expr(f"array({', '.join(_catalog_sql(records))})")
    text = F.expr("""array_join(concat(
        array(concat('# Data catalog: ', symbol), concat('Snapshot of ', timestamp, chr(10)), '| Partition | Chapters | Status |', '|---|---|---|'),
        transform(parts, p -> concat('| `', p.partition, '` | ', p.chapters, ' | ', p.status, ' |')),
        transform(parts, p -> concat(chr(10), '### `', p.partition, '`: ', p.title, chr(10), chr(10), p.summary))), chr(10))""")
    return records.select("symbol", "timestamp", parts.alias("parts")).select("symbol", text.alias("catalog"))
