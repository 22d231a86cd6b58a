"""Research record assembly, themed partitions and the availability catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.operators import enrich as en
from tickerloom.operators import partitions as pt
from tickerloom.plans import discovery_queries as dq
from tickerloom.plans.registry import joined, query
from tickerloom.plans.silver import SilverViews
from tickerloom.plans.source_queries import C_PARSED
from tickerloom.plans.views import RUN_DATE, Views
from tickerloom.session import materialize, small_tasks
from tickerloom.sources import landed as landed_rules
from tickerloom.sources.silver import bucketed_together


def statement_rows(v: Views) -> DataFrame:
    rows = v.v_financials.withColumn("field", F.concat_ws("_", "statement", "period"))
    return en.field_rows(rows, en.newest_first(), ["date", "revenue"], {f: en.ROW_FIELDS[f] for f in en.STATEMENTS})


def news_rows(v: Views) -> DataFrame:
    fields = ("stock_news", "press_releases", "analyst_estimates_annual", "insider_trades_search")
    return en.field_rows(v.v_news, en.newest_first(), ["date", "value"], {f: en.ROW_FIELDS[f] for f in fields})


def fundraising_of(v: Views) -> DataFrame:
    """Latest fundraising payload per CIK (the landed key padded to CIK form)."""
    latest = en.latest_payloads(v.v_landed.where(F.col("dataset") == "fundraising"))
    rows = en.normalized_payloads(latest)
    return rows.select(F.lpad(F.substring("symbol", 2, 20), 10, "0").alias("cik"), "rows")


def macro_of(v: Views) -> DataFrame:
    return en.macro_as_of(v.v_macro, RUN_DATE)


def assembled(v: Views, **store) -> DataFrame:
    # Five branches of the assembly start from the entries.
    return en.build_records(
        materialize(dq.stored_of(v), "entries"),
        profile=v.v_profile,
        row_datasets=[statement_rows(v), news_rows(v)],
        eod=v.v_eod,
        series=v.v_series,
        filings=v.v_filings,
        regulatory=v.v_regulatory,
        landed=v.v_landed,
        fundraising=fundraising_of(v),
        macro=materialize(macro_of(v), "macro") if store else macro_of(v),
        run_date=RUN_DATE,
        **store,
    )


def records_of(v: Views) -> DataFrame:
    """The stored record table; without one it is assembled from silver tables and written, once for a folder and session."""
    if type(v) is not Views:
        return assembled(v)
    silver = SilverViews(v)

    def build() -> DataFrame:
        with small_tasks(v.spark):
            return materialize(assembled(silver.prepare(), store=bucketed_together), "records")

    return silver.stored("records", build)


# --- macro bundle ----------------------------------------------------------------

C_MACRO = f"""
SELECT * FROM {{v_macro}} WHERE (part <> 'economic_indicators' OR name IN ('GDP', 'realGDP', 'inflationRate', 'unemploymentRate'))
  AND (part <> 'economic_calendar' OR date BETWEEN DATE '{RUN_DATE}' AND CAST(DATE '{RUN_DATE}' + INTERVAL 21 DAY AS DATE))
  AND (part NOT LIKE '%snapshot' OR date = DATE '{RUN_DATE}')"""
C_TRIMMED = """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY part, name ORDER BY ord) AS head,
    ROW_NUMBER() OVER (PARTITION BY part, name ORDER BY ord DESC) AS tail FROM {c_macro}) t
WHERE CASE part WHEN 'treasury_rates' THEN tail <= 30 WHEN 'economic_indicators' THEN tail <= 14
  WHEN 'economic_calendar' THEN head <= 50 WHEN 'sector_performance_snapshot' THEN head <= 60
  WHEN 'industry_performance_snapshot' THEN head <= 80 WHEN 'sector_pe_snapshot' THEN head <= 40
  WHEN 'industry_pe_snapshot' THEN head <= 80 ELSE TRUE END"""


@query("a01_macro_inventory", """
SELECT part, coalesce(name, '') AS name, COUNT(*) AS rows, MIN(ord) AS first_ord, MAX(ord) AS last_ord FROM {c_macro}
GROUP BY part, name""", c_macro=C_MACRO)
def a01(v):
    rows = en.macro_inventory(macro_of(v))
    return rows.withColumn("name", F.coalesce("name", F.lit("")))


@query("a01_unknown_macro", """
SELECT part, coalesce(name, '') AS name, COUNT(*) AS rows FROM {v_macro}
WHERE part = 'economic_indicators' AND coalesce(name, '') NOT IN ('GDP', 'realGDP', 'inflationRate', 'unemploymentRate') GROUP BY part, name""")
def a01_unknown(v):
    return en.unknown_macro(v.v_macro).withColumn("name", F.coalesce("name", F.lit("")))


@query("a02_macro_trimmed", "SELECT part, coalesce(name, '') AS name, ord, value FROM {c_trimmed}",
       c_macro=C_MACRO, c_trimmed=C_TRIMMED)
def a02(v):
    return en.macro_trimmed(macro_of(v)).select("part", F.coalesce("name", F.lit("")).alias("name"), "ord", "value")


@query("a02_macro_bundle", """
SELECT 'treasury_rates_tail' AS part, '' AS name, COUNT(*) AS points, SUM(value) AS total FROM {c_trimmed} WHERE part = 'treasury_rates'
UNION ALL SELECT part, '', COUNT(*), SUM(value) FROM {c_trimmed} WHERE part NOT IN ('treasury_rates', 'economic_indicators') GROUP BY part
UNION ALL SELECT 'economic_indicators_trimmed', name, COUNT(*), SUM(value) FROM {c_trimmed}
  WHERE part = 'economic_indicators' GROUP BY name""", c_macro=C_MACRO, c_trimmed=C_TRIMMED)
def a02_bundle(v):
    bundle = en.macro_bundle(macro_of(v), RUN_DATE)
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x["value"])
    lists = [c for c in bundle.columns if c not in ("prefetch_as_of", "economic_indicators_trimmed")]
    flat = bundle.select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.lit("").alias("name"), F.col(c).alias("p"))
                                            for c in lists])))
    named = bundle.select(F.explode("economic_indicators_trimmed").alias("name", "p")).select(
        F.lit("economic_indicators_trimmed").alias("part"), "name", "p")
    return flat.unionByName(named).where(F.size("p") > 0).select(
        "part", "name", F.size("p").cast("long").alias("points"), total(F.col("p")).alias("total"))


@query("a03_tail_head", """
SELECT symbol, COUNT(*) FILTER (WHERE tail <= 40) AS tail_size, MIN(ord) FILTER (WHERE tail <= 40) AS tail_first,
  COUNT(*) FILTER (WHERE head <= 50) AS head_size, MAX(ord) FILTER (WHERE head <= 50) AS head_last
FROM (SELECT symbol, ord, ROW_NUMBER() OVER (PARTITION BY symbol, CAST(floor(ord / 10000) AS BIGINT) ORDER BY ord DESC) AS tail,
    ROW_NUMBER() OVER (PARTITION BY symbol, CAST(floor(ord / 10000) AS BIGINT) ORDER BY ord) AS head,
    CAST(floor(ord / 10000) AS BIGINT) AS y FROM {v_eod}) t GROUP BY symbol, y""")
def a03(v):
    """Head and tail of each symbol's yearly list (a year bounds the list's length)."""
    from tickerloom.functions.collections import head, tail

    yearly = v.v_eod.groupBy("symbol", F.floor(F.col("ord") / 10000).alias("y")).agg(
        F.sort_array(F.collect_list("ord")).alias("days"))
    last, first = tail(F.col("days"), 40), head(F.col("days"), 50)
    return yearly.select(
        "symbol", F.size(last).cast("long").alias("tail_size"), F.get(last, F.lit(0)).alias("tail_first"),
        F.size(first).cast("long").alias("head_size"), F.element_at(first, -1).alias("head_last"))


# --- the record as counts per symbol, in SQL ------------------------------------------

C_FIELDS = """
SELECT symbol, field, COUNT(*) AS n FROM (
  SELECT symbol, statement || '_' || period AS field, ROW_NUMBER() OVER (PARTITION BY symbol, statement, period ORDER BY date DESC, ord) AS rank
  FROM {v_financials}
  UNION ALL SELECT symbol, field, ROW_NUMBER() OVER (PARTITION BY symbol, field ORDER BY date DESC, ord) FROM {v_news}) t
WHERE rank <= CASE field WHEN 'income_statement_annual' THEN 8 WHEN 'income_statement_quarter' THEN 8 WHEN 'stock_news' THEN 30
  WHEN 'press_releases' THEN 25 WHEN 'analyst_estimates_annual' THEN 12 WHEN 'insider_trades_search' THEN 35 ELSE 6 END
GROUP BY symbol, field
UNION ALL SELECT symbol, 'company_eod_recent', COUNT(*) FROM {c_prices} GROUP BY symbol
UNION ALL SELECT symbol, 'benchmark_eod_recent', COUNT(*) FROM {c_bench} GROUP BY symbol
UNION ALL SELECT symbol, 'filings', COUNT(*) FROM {c_recent} GROUP BY symbol
UNION ALL SELECT symbol, CASE WHEN list = 'disclosures' THEN 'disclosure_filings_matched' ELSE 'prospectus_entries_matched' END,
  COUNT(*) FROM {c_matched} GROUP BY symbol, list"""
C_LATEST = """
SELECT *, CASE WHEN http_status IS NULL OR http_status >= 400
      THEN 'http_status: ' || coalesce(CAST(http_status AS STRING), 'none')
    WHEN dataset IN ('company-notes', 'stock-peers', 'key-executives', 'revenue-product-segmentation',
      'revenue-geographic-segmentation') AND parse_error IS NULL AND n_bad > 0 THEN 'non_object_entries'
    WHEN dataset = 'ipos-calendar' AND parse_error IS NULL AND coalesce(kind, '') <> 'ARRAY' THEN 'unexpected_type'
    WHEN dataset IN ('company-notes', 'stock-peers', 'key-executives', 'revenue-product-segmentation',
      'revenue-geographic-segmentation') AND parse_error IS NULL
      AND kind NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN 'unexpected_type'
    ELSE parse_error END AS error
FROM {c_p} QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol, dataset ORDER BY event_id DESC) = 1"""
C_PAYLOADS = """
SELECT symbol, dataset, error, CASE WHEN error IS NOT NULL THEN 0 WHEN kind = 'OBJECT' THEN 1 WHEN kind = 'ARRAY' THEN n ELSE 0 END AS n,
  error IS NULL AND p IS NOT NULL AND kind <> 'NULL' AND p NOT IN ('[]', '{{}}') AS filled FROM {c_latest}"""
_COUNTS = {f: f"coalesce(MAX(n) FILTER (WHERE field = '{f}'), 0)" for f in (*en.ROW_FIELDS, "benchmark_eod_recent")}
_LISTS = ("company_notes", "stock_peers", "key_executives", "revenue_product_segmentation", "revenue_geographic_segmentation")
C_RECORD = f"""
SELECT e.symbol, e.resolved_cik, e.window_from, e.date, e.exchange, e.price_range, e.shares, e.market_cap, e.company,
  p.symbol IS NOT NULL AS has_profile, p.company_name, p.industry AS p_industry, p.sector AS p_sector, p.employees, p.ceo, p.website,
  p.description, n.sector, n.industry, coalesce(s.n, 0) AS sector_n, coalesce(i.n, 0) AS industry_n,
  coalesce(r.n, 0) AS fundraising_n, f.*, l.*
FROM {{c_window}} e LEFT JOIN {{v_profile}} p ON p.symbol = e.symbol LEFT JOIN {{c_names}} n ON n.symbol = e.symbol
LEFT JOIN {{c_tails}} s ON s.level = 'sector' AND s.name = n.sector
LEFT JOIN {{c_tails}} i ON i.level = 'industry' AND i.name = n.industry
LEFT JOIN (SELECT lpad(substr(symbol, 2), 10, '0') AS cik, n FROM {{c_payloads}} WHERE dataset = 'fundraising') r ON r.cik = e.resolved_cik
LEFT JOIN (SELECT symbol AS f_symbol, {', '.join(f'{x} AS {f}' for f, x in _COUNTS.items())} FROM {{c_fields}} GROUP BY symbol) f
  ON f.f_symbol = e.symbol
LEFT JOIN (SELECT symbol AS l_symbol, COUNT(error) AS errors, """ + ", ".join(
    f"coalesce(MAX({'n' if f in _LISTS else 'CAST(filled AS INT)'}) FILTER (WHERE dataset = '{ds}'), 0) AS {f}"
    for f, ds in en.PAYLOAD_FIELDS.items()) + """,
  string_agg(dataset || '=' || error, ';' ORDER BY dataset) FILTER (WHERE error IS NOT NULL) AS error_list
  FROM {c_payloads} GROUP BY symbol) l ON l.l_symbol = e.symbol"""
_TAGS = [
    "TRUE", "has_profile", "company_notes > 0", "fundraising_n > 0", "sector_n > 0 OR industry_n > 0",
    " OR ".join(f"{s} > 0" for s in (*en.STATEMENTS, "key_metrics_ttm", "ratios_ttm")), "company_eod_recent > 0", "quote > 0",
    "stock_news > 0 OR press_releases > 0", "stock_peers > 0",
    "key_executives > 0 OR shares_float > 0 OR insider_trading_statistics > 0 OR insider_trades_search > 0",
    "analyst_estimates_annual > 0 OR price_target_summary > 0 OR price_target_consensus > 0 OR ratings_snapshot > 0",
    "financial_scores > 0 OR revenue_product_segmentation > 0 OR revenue_geographic_segmentation > 0", "filings > 0",
    "disclosure_filings_matched > 0 OR prospectus_entries_matched > 0", "TRUE",
]
_SOURCES = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {cond} THEN '{tag}' END" for cond, tag in zip(_TAGS, fv.SOURCE_TAGS, strict=True)) + ")"
RECORD = {**dq.STORED_CTES, "c_matched": dq.C_MATCHED, "c_prices": dq.C_PRICES, "c_bench": dq.C_BENCH, "c_recent": dq.C_RECENT,
          "c_names": dq.C_NAMES, "c_tails": dq.C_TAILS, "c_fields": C_FIELDS, "c_p": C_PARSED, "c_latest": C_LATEST,
          "c_payloads": C_PAYLOADS, "c_record": C_RECORD}

# path of each list or flag inside the record -> its column in the SQL form
_PATHS = {}
for _f in en.STATEMENTS:
    _PATHS[f"financials.{_f}"] = _f
for _path in ("financials.key_metrics_ttm", "financials.ratios_ttm", "company_notes", "comparables.stock_peers",
              "ownership_governance.key_executives", "ownership_governance.shares_float",
              "ownership_governance.insider_trading_statistics", "ownership_governance.insider_trades_search",
              "sell_side.analyst_estimates_annual", "sell_side.price_target_summary", "sell_side.price_target_consensus",
              "sell_side.ratings_snapshot", "fundamental_extras.financial_scores",
              "fundamental_extras.revenue_product_segmentation", "fundamental_extras.revenue_geographic_segmentation",
              "news_context.stock_news", "news_context.press_releases", "sec_filings_recent.filings",
              "market_context.company_eod_recent", "market_context.benchmark_eod_recent", "market_context.quote",
              "ipo_regulatory_context.disclosure_filings_matched", "ipo_regulatory_context.prospectus_entries_matched"):
    _PATHS[_path] = _path.split(".")[-1]
_PATHS["fundraising"] = "fundraising_n"
_PATHS["fetch_errors"] = "errors"
_PATHS["sector_industry_context.historical_sector_performance"] = "sector_n"
_PATHS["sector_industry_context.historical_industry_performance"] = "industry_n"
_TEXTS = {
    "ipo_data.date": "CAST(date AS STRING)", "ipo_data.exchange": "exchange", "ipo_data.priceRange": "price_range",
    "ipo_data.shares": "CAST(shares AS STRING)", "ipo_data.marketCap": "CAST(market_cap AS STRING)",
    "ipo_data.company": "company", "resolved_cik": "resolved_cik", "company_profile.companyName": "company_name",
    "company_profile.industry": "p_industry", "company_profile.sector": "p_sector",
    "company_profile.fullTimeEmployees": "CAST(employees AS STRING)", "company_profile.ceo": "ceo",
    "company_profile.website": "website", "company_profile.description": "description",
    "sec_filings_recent.window_from": f"CAST(CAST(DATE '{RUN_DATE}' - INTERVAL 730 DAY AS DATE) AS STRING)",
    "sec_filings_recent.window_to": f"'{RUN_DATE}'", "global_market_context.prefetch_as_of": f"'{RUN_DATE}'",
    "sector_industry_context.identifiers.sector": "sector", "sector_industry_context.identifiers.industry": "industry",
}
_BUNDLE = {"treasury_rates_tail": "treasury_rates"}


def _metric_sql(path: str, kind: str) -> tuple[str, str]:
    """(value, detail) of a summary metric in SQL."""
    if path in _TEXTS:
        text = _TEXTS[path]
        short = f"CASE WHEN length({text}) > 80 THEN substr({text}, 1, 77) || '...' ELSE {text} END"
        return f"CASE WHEN {text} IS NULL THEN 0 ELSE 1 END", short
    if path.startswith("global_market_context."):
        part = path.split(".")[1]
        found = f"(SELECT COUNT(*) FROM {{c_trimmed}} WHERE part = '{_BUNDLE.get(part, part)}')"
        return (found if kind == "rows" else f"least({found}, 1)"), "NULL"
    column = f"coalesce({_PATHS[path]}, 0)"
    return (column if kind == "rows" else f"least({column}, 1)"), "NULL"


C_SUMMARY = "\nUNION ALL\n".join(
    f"SELECT symbol, '{name}' AS partition, {i * 100 + j} AS metric_no, '{path}' AS metric, '{kind}' AS kind, "
    f"CAST({_metric_sql(path, kind)[0]} AS BIGINT) AS value, {_metric_sql(path, kind)[1]} AS detail FROM {{c_record}}"
    for i, (name, metrics) in enumerate(pt.SUMMARY_PLAN.items(), 1) for j, (path, kind) in enumerate(metrics))
SUMMARY = {**RECORD, "c_macro": C_MACRO, "c_trimmed": C_TRIMMED, "c_summary": C_SUMMARY}
_TOP_EMPTY = {"resolved_cik": "resolved_cik IS NOT NULL", "company_profile": "has_profile", "company_notes": "company_notes > 0",
              "fundraising": "fundraising_n > 0", "fetch_errors": "errors > 0"}
C_STATUS = "\nUNION ALL\n".join(
    f"SELECT symbol, {i} AS part_no, '{name}' AS partition, CASE WHEN k = 0 THEN 'empty' WHEN k < {len(keys)} THEN 'partial' "
    f"ELSE 'full' END AS status FROM (SELECT symbol, "
    + " + ".join(f"CASE WHEN {_TOP_EMPTY.get(k, 'TRUE')} THEN 1 ELSE 0 END" for k in keys) + " AS k FROM {c_record}) t"
    for i, (name, _, _, keys) in enumerate(fv.PARTITION_PLAN, 1))
CATALOG = {**SUMMARY, "c_status": C_STATUS}


def size_of(path: str):
    return F.size(F.col(path)).cast("long").alias(path.split(".")[-1])


@query("a04_research_record", f"""
SELECT symbol, coalesce(resolved_cik, '') AS resolved_cik, CAST(window_from AS STRING) AS window_from,
  {', '.join(f'CAST(coalesce({f}, 0) AS BIGINT) AS {f}' for f in (*_COUNTS, *_LISTS))},
  CAST(fundraising_n AS BIGINT) AS fundraising, {_SOURCES} AS data_sources FROM {{c_record}}""", **RECORD)
def a04(v):
    places = {
        **{s: f"financials.{s}" for s in en.STATEMENTS},
        **{p.split(".")[-1]: p for p in _PATHS if not p.startswith("financials.") and p.split(".")[-1] in (*_COUNTS, *_LISTS)},
    }
    return records_of(v).select(
        "symbol", F.coalesce("resolved_cik", F.lit("")).alias("resolved_cik"),
        F.col("market_context.window_from").cast("string").alias("window_from"),
        *[size_of(places[f]).alias(f) for f in (*_COUNTS, *_LISTS)],
        F.size("fundraising").cast("long").alias("fundraising"),
        joined("data_sources"),
    )


@query("a05_financial_coverage", f"SELECT symbol, coalesce({_TAGS[5]}, FALSE) AS covered FROM {{c_record}}", **RECORD)
def a05(v):
    return records_of(v).select("symbol", en.financials_covered().alias("covered"))


@query("a06_lineage", f"SELECT symbol, {_SOURCES} AS data_sources FROM {{c_record}}", **RECORD)
def a06(v):
    return records_of(v).select("symbol", joined("data_sources"))


@query("a07_fetch_errors", """
SELECT symbol, COUNT(*) AS errors, string_agg(dataset || '=' || error, ';' ORDER BY dataset) AS steps FROM {c_payloads}
WHERE error IS NOT NULL GROUP BY symbol""", c_p=C_PARSED, c_latest=C_LATEST, c_payloads=C_PAYLOADS)
def a07(v):
    rows = en.fetch_errors(v.v_landed)
    steps = F.transform("fetch_errors", lambda e: F.concat_ws("=", e["step"], e["error"]))
    return rows.select("symbol", F.size("fetch_errors").cast("long").alias("errors"), F.array_join(steps, ";").alias("steps"))


@query("n12_populated", """
SELECT event_id, coalesce(p IS NOT NULL AND kind <> 'NULL' AND p NOT IN ('[]', '{{}}'), FALSE) AS populated FROM {c_p}""",
       c_p=C_PARSED)
def n12(v):
    from tickerloom.functions.collections import variant_populated

    rows = landed_rules.parse_payloads(v.v_landed)
    return rows.select("event_id", variant_populated("body").alias("populated"))


_KEYS = "\nUNION ALL\n".join(
    f"SELECT symbol, {i} AS part_no, '{name}' AS partition, '{','.join(['_meta', *keys])}' AS keys, {_SOURCES} AS sources FROM {{c_record}}"
    for i, (name, _, _, keys) in enumerate(fv.PARTITION_PLAN, 1))


@query("c01_split_record", f"""
SELECT symbol, CAST(part_no AS BIGINT) AS part_no, partition, keys, len(string_split(sources, ',')) AS n_sources FROM ({_KEYS}) t""",
       **RECORD)
def c01(v):
    parts = pt.split_record(records_of(v))
    sources = F.json_array_length(F.get_json_object("payload", "$._meta.data_sources"))
    return parts.select(
        F.get_json_object("payload", "$._meta.symbol").alias("symbol"), F.col("part_no").cast("long").alias("part_no"), "partition",
        F.array_join(F.json_object_keys("payload"), ",").alias("keys"), sources.cast("long").alias("n_sources"))


@query("c02_availability", "SELECT symbol, CAST(part_no AS BIGINT) AS part_no, partition, status FROM {c_status}", **CATALOG)
def c02(v):
    return pt.availability(records_of(v)).withColumn("part_no", F.col("part_no").cast("long"))


@query("c03_payload_metrics", """
SELECT symbol, partition, metric, value, CASE WHEN value > 0 THEN 'populated' ELSE 'missing' END AS status, detail
FROM {c_summary}""", **SUMMARY)
def c03(v):
    return pt.payload_metrics(records_of(v)).select("symbol", "partition", "metric", "value", "status", "detail")


@query("c04_catalog", """
SELECT s.symbol, CAST(s.part_no AS BIGINT) AS part_no, s.partition, s.status, string_agg('- ' || metric || ': '
    || CASE WHEN value = 0 THEN 'missing' WHEN kind = 'rows' THEN CAST(value AS STRING) ELSE coalesce(detail, 'populated') END,
    chr(10) ORDER BY metric_no) AS summary
FROM {c_status} s JOIN {c_summary} m ON m.symbol = s.symbol AND m.partition = s.partition
GROUP BY s.symbol, s.part_no, s.partition, s.status""", **CATALOG)
def c04(v):
    rows = pt.build_catalog(records_of(v))
    return rows.select("symbol", F.col("part_no").cast("long").alias("part_no"), "partition", "status", "summary")


@query("c04_rendered_catalog")
def c04_rendered(v):
    return pt.render_catalog(records_of(v))


@query("c05_error_samples", """
SELECT symbol, errors, array_to_string(list_slice(string_split(steps, ';'), 1, 5), ';') AS samples FROM (
  SELECT symbol, COUNT(*) AS errors, string_agg(dataset || ': ' || substr(error, 1, 80), ';' ORDER BY dataset) AS steps
  FROM {c_payloads} WHERE error IS NOT NULL GROUP BY symbol) t""", c_p=C_PARSED, c_latest=C_LATEST, c_payloads=C_PAYLOADS)
def c05(v):
    rows = pt.error_samples(en.fetch_errors(v.v_landed))
    return rows.select("symbol", F.col("errors").cast("long").alias("errors"), F.array_join("samples", ";").alias("samples"))
