"""One nested research record per company.

Every row dataset is ranked and cut to its limit on its own typed columns,
then brought to a common (symbol, field, rank, row) form and folded to one
array per field in one shuffle, however many datasets there are.  Nothing is
collected before it was cut.  Landed payloads are reduced to the latest one per
(symbol, dataset) first, which bounds a symbol's rows by the number of datasets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.collections import array_populated_sql, head, tail, variant_truthy_sql
from tickerloom.operators import discovery as d
from tickerloom.sources import landed as landed_rules
from tickerloom.sources.catalog import BY_NAME, names_with_shape
from tickerloom.sources.scans import first_per_group, latest_rows

# field of the record -> dataset whose latest landed payload fills it
PAYLOAD_FIELDS = {
    "company_notes": "company-notes",
    "key_metrics_ttm": "key-metrics-ttm",
    "ratios_ttm": "ratios-ttm",
    "quote": "quote",
    "stock_peers": "stock-peers",
    "key_executives": "key-executives",
    "shares_float": "shares-float",
    "insider_trading_statistics": "insider-trading/statistics",
    "price_target_summary": "price-target-summary",
    "price_target_consensus": "price-target-consensus",
    "ratings_snapshot": "ratings-snapshot",
    "financial_scores": "financial-scores",
    "revenue_product_segmentation": "revenue-product-segmentation",
    "revenue_geographic_segmentation": "revenue-geographic-segmentation",
}
# field of the record -> row limit of its row dataset
ROW_FIELDS = {
    "income_statement_annual": 8,
    "income_statement_quarter": 8,
    "balance_sheet_annual": 6,
    "cash_flow_annual": 6,
    "key_metrics_annual": 6,
    "ratios_annual": 6,
    "enterprise_values_annual": 6,
    "company_eod_recent": fv.EOD_MAX_ROWS,
    "stock_news": 30,
    "press_releases": 25,
    "analyst_estimates_annual": 12,
    "insider_trades_search": 35,
    "filings": fv.FILINGS_LIMIT,
    "disclosure_filings_matched": fv.REGULATORY_MAX_ROWS,
    "prospectus_entries_matched": fv.REGULATORY_MAX_ROWS,
}
POINTS = "array<struct<ord: bigint, date: date, value: double>>"
STATEMENTS = [f for f in ROW_FIELDS if f.endswith("_annual") or f.endswith("_quarter")]
STATEMENTS.remove("analyst_estimates_annual")


# --- macro bundle -------------------------------------------------------------

def macro_as_of(macro: DataFrame, as_of: date | str) -> DataFrame:
    """The rows one run reads: snapshots of the day, calendar of the coming weeks, whole series."""
    today = F.lit(as_of).cast("date")
    ahead = F.col("date").between(today, F.date_add(today, fv.MACRO_CALENDAR_DAYS))
    return macro.where(
        ((F.col("part") != "economic_calendar") | ahead)
        & (~F.col("part").endswith("snapshot") | (F.col("date") == today))
    )


def macro_rows(macro: DataFrame) -> DataFrame:
    """The run's macro bundle as rows (part, name, ord, …), unknown parts dropped.

    ``name`` separates the indicator series; other parts have one unnamed list.
    """
    parts = list(fv.MACRO_TRIM) + ["etf_sector_weightings_spy", "major_index_batch_quotes", "market_risk_premium"]
    known = macro.where(F.col("part").isin(parts))
    return known.where((F.col("part") != "economic_indicators") | F.col("name").isin(fv.INDICATORS))


def unknown_macro(macro: DataFrame) -> DataFrame:
    """Rows per part and series that no rule knows: what ``macro_rows`` leaves out, counted."""
    parts = list(fv.MACRO_TRIM) + ["etf_sector_weightings_spy", "major_index_batch_quotes", "market_risk_premium"]
    known = F.col("part").isin(parts) & ((F.col("part") != "economic_indicators") | F.col("name").isin(fv.INDICATORS))
    return macro.where(~F.coalesce(known, F.lit(False))).groupBy("part", "name").agg(F.count("*").alias("rows"))


def unknown_fields(df: DataFrame, limits: dict[str, int] = ROW_FIELDS) -> DataFrame:
    """Rows per field name that has no limit: what ``field_rows`` leaves out, counted."""
    return df.where(~F.coalesce(F.col("field").isin(list(limits)), F.lit(False))).groupBy("field").agg(F.count("*").alias("rows"))


def macro_inventory(macro: DataFrame) -> DataFrame:
    """Rows per part and series; a part that failed to load simply has none."""
    return macro_rows(macro).groupBy("part", "name").agg(
        F.count("*").alias("rows"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


def _limit_of(name: str, limits: dict[str, int]) -> Column:
    whens = " ".join(f"WHEN '{key}' THEN {n}" for key, n in limits.items())
    return F.expr(f"CASE {name} {whens} ELSE 0 END")


def macro_trimmed(macro: DataFrame) -> DataFrame:
    """Each part cut to its end: heads keep the first rows, tails the last."""
    rows = macro_rows(macro)
    pieces = []
    for end in ("head", "tail"):
        limits = {p: n for p, (e, n) in fv.MACRO_TRIM.items() if e == end}
        order = F.col("ord") if end == "head" else F.col("ord").desc()
        limit = _limit_of("part", limits)
        chosen = first_per_group(
            rows.where(F.col("part").isin(list(limits))), ["part", "name"], [order], max(limits.values()))
        pieces.append(chosen.where(F.col("rank") <= limit).drop("rank"))
    rest = rows.where(~F.col("part").isin(list(fv.MACRO_TRIM)))
    return reduce(DataFrame.unionByName, [*pieces, rest])


def macro_bundle(macro: DataFrame, as_of: date | str) -> DataFrame:
    """The trimmed bundle as one row: an array per part, a map for the indicators."""
    series = macro_trimmed(macro).groupBy("part", "name").agg(
        F.sort_array(F.collect_list(F.struct("ord", "date", "value"))).alias("points"))
    lists = [p for p in fv.MACRO_TRIM if p != "economic_indicators"] + ["etf_sector_weightings_spy", "major_index_batch_quotes"]
    names = {"treasury_rates": "treasury_rates_tail"}
    one = "first(points, true) FILTER (WHERE part = '{}')"
    return series.agg(
        F.lit(as_of).cast("date").alias("prefetch_as_of"),
        *[F.expr(f"coalesce({one.format(p)}, CAST(array() AS {POINTS})) AS {names.get(p, p)}") for p in lists],
        F.expr(one.format("market_risk_premium")).alias("market_risk_premium"),
        F.expr("map_from_entries(sort_array(collect_list(struct(name, points)) FILTER (WHERE part = 'economic_indicators')))")
        .alias("economic_indicators_trimmed"),
    )


def compact_bundle(bundle: DataFrame) -> DataFrame:
    """Trim an already nested bundle (arrays per part) to the same limits."""
    out = bundle
    for name, (end, n) in fv.MACRO_TRIM.items():
        if name not in bundle.columns:
            continue
        cut = tail if end == "tail" else head
        if name == "economic_indicators":
            trimmed = F.transform_values(name, lambda _, v: cut(v, n))  # noqa: B023
        else:
            trimmed = cut(F.coalesce(name, F.array()), n)
        out = out.withColumn(name, trimmed)
    return out


# --- row datasets ---------------------------------------------------------------

def ranked_rows(ranked: DataFrame, field: str | Column, body: Sequence[str]) -> DataFrame:
    """Bring ranked rows to the common form (symbol, field, rank, row)."""
    name = F.lit(field) if isinstance(field, str) else field
    return ranked.select(
        "symbol", name.alias("field"), "rank", F.to_variant_object(F.struct(*body)).alias("row"))


def field_rows(df: DataFrame, order: Sequence[Column], body: Sequence[str], limits: dict[str, int] = ROW_FIELDS) -> DataFrame:
    """Cut a row dataset (with its ``field`` column) to each field's limit, then convert what is left.

    The ranking runs on the typed columns, so only surviving rows become
    VARIANT values and surplus rows are dropped before the shuffle.  ``limits``
    should name the dataset's own fields only: the shuffle carries as many rows
    of every field as the largest limit allows.
    """
    known = df.where(F.col("field").isin(list(limits)))
    ranked = first_per_group(known, ["symbol", "field"], order, max(limits.values()))
    return ranked_rows(ranked.where(F.col("rank") <= _limit_of("field", limits)), F.col("field"), body)


def newest_first(day: str = "date") -> list[Column]:
    return [F.col(day).desc(), F.col("ord")]


def fold_fields(rows: DataFrame, fields: Sequence[str] = tuple(ROW_FIELDS)) -> DataFrame:
    """One row per symbol with one array per field; every list was cut before."""
    # Dealt by symbol once, both aggregates then run where the rows are.
    lists = (
        rows.repartition("symbol").groupBy("symbol", "field")
        .agg(F.collect_list(F.struct("rank", "row")).alias("ranked"))
        .withColumn("list", F.expr("transform(array_sort(ranked, (a, b) -> a.rank - b.rank), x -> x.row)"))
    )
    return lists.groupBy("symbol").agg(
        *[F.expr(f"first(list, true) FILTER (WHERE field = '{f}') AS {f}") for f in fields]
    )


# --- landed payloads ------------------------------------------------------------

def latest_payloads(landed: DataFrame) -> DataFrame:
    """Latest landed payload of each (symbol, dataset)."""
    return latest_rows(landed, ["symbol", "dataset"], "event_id").select("symbol", "dataset", "http_status", "payload")


def normalized_payloads(latest: DataFrame) -> DataFrame:
    """Apply each dataset's shape rule; failures carry ``error`` and no value."""
    rows_shape, lenient = names_with_shape("rows"), names_with_shape("lenient_rows")
    strict, single = names_with_shape("strict_rows"), names_with_shape("singleton")
    parsed = landed_rules.list_rows(latest)
    by_rows, is_list = F.col("dataset").isin(rows_shape), F.col("kind") == "list"
    no_list = F.col("dataset").isin(strict) & ~is_list
    elements = F.when(is_list, F.try_variant_get("body", "$", "array<variant>"))
    error = F.coalesce(
        F.col("parse_error"),
        F.when(by_rows, F.col("row_error")),
        F.when(no_list | (F.col("dataset").isin(single) & ~F.col("kind").isin("list", "object")), F.lit("unexpected_type")),
        F.when(F.col("dataset").isin(single) & (F.size(elements) == 0), F.lit("no_rows")),
    )
    fetch_failed = landed_rules.fetch_class(F.col("http_status")) != "ok"
    problem = F.when(fetch_failed, F.concat(F.lit("http_status: "), F.coalesce(
        F.col("http_status").cast("string"), F.lit("none")))).otherwise(error)
    good = problem.isNull()
    none = F.array().cast("array<variant>")
    rows = (
        F.when(F.col("dataset").isin([*lenient, *strict]), F.coalesce(elements, F.col("rows")))
        .when(F.col("dataset").isin(single), F.coalesce(F.slice(elements, 1, 1), F.col("rows")))
        .otherwise(F.col("rows"))
    )
    return parsed.select(
        "symbol", "dataset", problem.alias("error"),
        F.when(good, rows).otherwise(none).alias("rows"),
        F.when(good, F.col("body")).alias("body"),
    )


def fold_payloads(normalized: DataFrame) -> DataFrame:
    """One row per symbol: a column per payload field, plus its errors by step name."""
    def pick(field: str, dataset: str) -> Column:
        value = "rows" if BY_NAME[dataset].shape == "rows" else "body"
        return F.expr(f"first({value}, true) FILTER (WHERE dataset = '{dataset}') AS {field}")

    return normalized.groupBy("symbol").agg(
        *[pick(f, name) for f, name in PAYLOAD_FIELDS.items()],
        F.expr("sort_array(collect_list(named_struct('step', dataset, 'error', error)) FILTER (WHERE error IS NOT NULL))")
        .alias("fetch_errors"),
    )


def fetch_errors(landed: DataFrame) -> DataFrame:
    """Failed steps per symbol; the number per symbol is bounded by the dataset list."""
    return (
        normalized_payloads(latest_payloads(landed))
        .where("error is not null")
        .groupBy("symbol")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("dataset").alias("step"), "error"))).alias("fetch_errors"))
    )


# --- assembly ---------------------------------------------------------------------

def _covered_sql() -> str:
    lists = [array_populated_sql(f"financials.{s}") for s in STATEMENTS]
    return " OR ".join(lists + [variant_truthy_sql(f"financials.{s}") for s in ("key_metrics_ttm", "ratios_ttm")])


def financials_covered() -> Column:
    """True when any statement list or trailing-twelve-month payload holds something."""
    return F.expr(_covered_sql())


def lineage() -> Column:
    """Tags of the non-empty source groups, in their fixed order."""
    some = lambda section, *fields: " OR ".join(array_populated_sql(section + f) for f in fields)
    truthy = lambda section, *fields: " OR ".join(variant_truthy_sql(section + f) for f in fields)
    own, sell, extra = "ownership_governance.", "sell_side.", "fundamental_extras."
    present = [
        "true",
        "company_profile IS NOT NULL",
        some("", "company_notes"),
        some("", "fundraising"),
        some("sector_industry_context.", "historical_sector_performance", "historical_industry_performance"),
        _covered_sql(),
        some("market_context.", "company_eod_recent"),
        truthy("market_context.", "quote"),
        some("news_context.", "stock_news", "press_releases"),
        some("comparables.", "stock_peers"),
        some(own, "key_executives", "insider_trades_search") + " OR " + truthy(own, "shares_float", "insider_trading_statistics"),
        some(sell, "analyst_estimates_annual") + " OR "
        + truthy(sell, "price_target_summary", "price_target_consensus", "ratings_snapshot"),
        truthy(extra, "financial_scores") + " OR "
        + some(extra, "revenue_product_segmentation", "revenue_geographic_segmentation"),
        some("sec_filings_recent.", "filings"),
        some("ipo_regulatory_context.", "disclosure_filings_matched", "prospectus_entries_matched"),
        "global_market_context IS NOT NULL",
    ]
    tags = ", ".join(f"CASE WHEN {p} THEN '{t}' END" for p, t in zip(present, fv.SOURCE_TAGS, strict=True))
    return F.expr(f"array_compact(array({tags}))")


def build_records(
    entries: DataFrame,
    *,
    profile: DataFrame,
    row_datasets: Sequence[DataFrame],
    eod: DataFrame,
    series: DataFrame,
    filings: DataFrame,
    regulatory: DataFrame,
    landed: DataFrame,
    fundraising: DataFrame,
    macro: DataFrame | None,
    run_date: date | str,
    store: Callable[[dict[str, Callable[[], DataFrame]]], dict[str, DataFrame]] = lambda tables: {n: t() for n, t in tables.items()},
) -> DataFrame:
    """Nested research record per entry; every section is optional, no entry is lost.

    ``entries`` has one row per symbol; ``row_datasets`` are outputs of
    ``field_rows``; ``fundraising`` is (cik, rows).  ``store`` may write the
    sections, one row per symbol each, for instance as tables with the same
    buckets (``silver.bucketed_together``), so that joining them moves no row.
    """
    keyed = d.price_window(d.resolve_cik(entries, profile), run_date)
    wanted = entries.select("symbol")

    def lists() -> DataFrame:
        return fold_fields(_section_rows(keyed, wanted, row_datasets, eod, filings, regulatory, run_date))

    who = profile.select("symbol", F.struct(
        F.col("company_name").alias("companyName"), "industry", "sector",
        F.col("employees").alias("fullTimeEmployees"), "ceo", "website", "description", "cik",
    ).alias("company_profile"))
    raised = fundraising.select(F.col("cik").alias("resolved_cik"), F.col("rows").alias("_raised"))
    sections = store({
        "lists": lists,
        # Payloads of other symbols would be parsed and folded only to find no entry.
        "payloads": lambda: fold_payloads(normalized_payloads(latest_payloads(landed.join(wanted, "symbol", "left_semi")))),
        "company": lambda: (
            d.window_benchmark(d.sector_history(keyed, profile, series), eod, run_date).join(who, "symbol", "left").join(raised, "resolved_cik", "left")
        ),
    })
    flat = sections["company"].join(sections["lists"], "symbol", "left").join(sections["payloads"], "symbol", "left")
    return _record_of(flat, macro, run_date)


def _section_rows(
    keyed: DataFrame, wanted: DataFrame, row_datasets: Sequence[DataFrame], eod: DataFrame, filings: DataFrame, regulatory: DataFrame, run_date: date | str
) -> DataFrame:
    """The cut rows of all row datasets of the wanted symbols: symbol, field, rank, row."""
    prices = ranked_rows(d.window_prices(keyed, eod, run_date), "company_eod_recent", ["date", "close", "adj_close"])
    recent = ranked_rows(d.recent_filings(filings, run_date), "filings", ["date", "form"])
    matched = ranked_rows(
        d.match_regulatory(keyed, regulatory),
        F.when(F.col("list") == "disclosures", "disclosure_filings_matched").otherwise("prospectus_entries_matched"),
        ["form", "row_cik", "row_symbol"])
    tables = reduce(DataFrame.unionByName, [*row_datasets, recent]).join(wanted, "symbol", "left_semi")
    return tables.unionByName(prices).unionByName(matched)


def _record_of(flat: DataFrame, macro: DataFrame | None, run_date: date | str) -> DataFrame:
    """The nested document of joined sections."""
    if macro is None:
        flat = flat.withColumn("global_market_context", F.lit(None).cast("struct<prefetch_as_of: date>"))
    else:
        # One value of a few hundred points at most, see MACRO_TRIM.
        bundle = macro_bundle(macro, run_date).select(F.struct("*").alias("bundle"))
        flat = flat.withColumn("global_market_context", bundle.scalar())

    rows = lambda *names: ", ".join(f"coalesce({n}, CAST(array() AS array<variant>)) AS {n}" for n in names)
    points = lambda n: f"coalesce({n}, CAST(array() AS {POINTS}))"
    day = f"DATE '{run_date}'"
    doc = flat.selectExpr(
        "symbol",
        f"date_format({day}, 'yyyy-MM-dd') AS timestamp",
        "struct(date, exchange, price_range AS priceRange, shares, market_cap AS marketCap, company, cik, expected_date) AS ipo_data",
        "company_profile",
        rows("company_notes"),
        "resolved_cik",
        "coalesce(_raised, CAST(array() AS array<variant>)) AS fundraising",
        f"""struct(struct(sector, industry) AS identifiers, {points('sector_history')} AS historical_sector_performance,
            {points('industry_history')} AS historical_industry_performance) AS sector_industry_context""",
        f"struct({rows(*STATEMENTS)}, key_metrics_ttm, ratios_ttm) AS financials",
        f"""struct('{fv.BENCHMARK_SYMBOL}' AS benchmark_symbol, window_from, window_to, {rows('company_eod_recent')},
            benchmark_eod_recent, quote) AS market_context""",
        f"struct({rows('stock_news', 'press_releases')}) AS news_context",
        f"struct({rows('stock_peers')}) AS comparables",
        f"""struct({rows('key_executives')}, shares_float, insider_trading_statistics, {rows('insider_trades_search')})
            AS ownership_governance""",
        f"""struct({rows('analyst_estimates_annual')}, price_target_summary, price_target_consensus, ratings_snapshot)
            AS sell_side""",
        f"""struct(financial_scores, {rows('revenue_product_segmentation', 'revenue_geographic_segmentation')})
            AS fundamental_extras""",
        f"""struct(date_sub({day}, {fv.FILINGS_DAYS}) AS window_from, {day} AS window_to, {rows('filings')})
            AS sec_filings_recent""",
        f"struct({rows('disclosure_filings_matched', 'prospectus_entries_matched')}) AS ipo_regulatory_context",
        "global_market_context",
        "coalesce(fetch_errors, CAST(array() AS array<struct<step: string, error: string>>)) AS fetch_errors",
    )
    return doc.withColumn("data_sources", lineage())
