"""The vendor datasets as data: what keys a dataset, its payload shape and its row limit."""

from __future__ import annotations

from typing import NamedTuple


class Dataset(NamedTuple):
    name: str
    key: str  # symbol | symbol_period | symbol_window | cik | window | day | series | symbols | none
    shape: str  # rows | strict_rows | singleton | untouched | historical | lenient_rows
    limit: int | None = None


# --- fixed values: dataset names, keys, shapes and the row limits in use -----
DATASETS = [
    Dataset("ipos-calendar", "window", "strict_rows"),
    Dataset("fundraising", "cik", "lenient_rows"),
    Dataset("profile", "symbol", "singleton"),
    Dataset("company-notes", "symbol", "rows"),
    Dataset("income-statement", "symbol_period", "rows", 8),
    Dataset("balance-sheet-statement", "symbol_period", "rows", 6),
    Dataset("cash-flow-statement", "symbol_period", "rows", 6),
    Dataset("key-metrics", "symbol_period", "rows", 6),
    Dataset("key-metrics-ttm", "symbol", "untouched"),
    Dataset("ratios", "symbol_period", "rows", 6),
    Dataset("ratios-ttm", "symbol", "untouched"),
    Dataset("enterprise-values", "symbol_period", "rows", 6),
    Dataset("news/stock", "symbol", "rows", 30),
    Dataset("news/press-releases", "symbol", "rows", 25),
    Dataset("ipos-disclosure", "none", "rows"),
    Dataset("ipos-prospectus", "none", "rows"),
    Dataset("stock-peers", "symbol", "rows"),
    Dataset("key-executives", "symbol", "rows"),
    Dataset("shares-float", "symbol", "untouched"),
    Dataset("quote", "symbol", "untouched"),
    Dataset("financial-scores", "symbol", "untouched"),
    Dataset("analyst-estimates", "symbol_period", "rows", 12),
    Dataset("price-target-summary", "symbol", "untouched"),
    Dataset("price-target-consensus", "symbol", "untouched"),
    Dataset("ratings-snapshot", "symbol", "untouched"),
    Dataset("sec-filings-search/symbol", "symbol_window", "rows", 40),
    Dataset("insider-trading/statistics", "symbol", "untouched"),
    Dataset("insider-trading/search", "symbol", "rows", 35),
    Dataset("revenue-product-segmentation", "symbol", "rows"),
    Dataset("revenue-geographic-segmentation", "symbol", "rows"),
    Dataset("treasury-rates", "none", "rows"),
    Dataset("market-risk-premium", "none", "untouched"),
    Dataset("economic-calendar", "window", "rows"),
    Dataset("economic-indicators", "series", "rows"),
    Dataset("sector-performance-snapshot", "day", "rows"),
    Dataset("industry-performance-snapshot", "day", "rows"),
    Dataset("sector-pe-snapshot", "day", "rows"),
    Dataset("industry-pe-snapshot", "day", "rows"),
    Dataset("historical-sector-performance", "series", "rows"),
    Dataset("historical-industry-performance", "series", "rows"),
    Dataset("etf/sector-weightings", "symbol", "rows"),
    Dataset("batch-quote", "symbols", "rows"),
    Dataset("historical-price-eod/full", "symbol_window", "historical"),
]

BY_NAME = {d.name: d for d in DATASETS}


def names_with_shape(*shapes: str) -> list[str]:
    return [d.name for d in DATASETS if d.shape in shapes]


class Field(NamedTuple):
    column: str
    vendor: str  # name in the payload
    kind: str


def _fields(*specs: str) -> tuple[Field, ...]:
    """Fields from "column kind" or "column=vendor kind"."""
    out = []
    for spec in specs:
        names, kind = spec.split(" ", 1)
        column, _, vendor = names.partition("=")
        out.append(Field(column, vendor or column, kind))
    return tuple(out)


_POINT = _fields("ord=id bigint", "date date", "value double")
_STATEMENT = _fields("ord=id bigint", "date date", "period string", "revenue bigint")
# --- fixed values: the payload fields that later steps read, and their types; everything else stays in ``leftover`` ----
FIELDS: dict[str, tuple[Field, ...]] = {
    "ipos-calendar": _fields(
        "ord=id bigint", "symbol string", "date date", "expected_date=expectedDate string", "company string", "exchange string", "cik string",
        "price_range=priceRange string", "shares bigint", "market_cap=marketCap bigint"),
    "fundraising": _fields("ord=id bigint", "cik string", "date date", "amount=totalOfferingAmount double"),
    "profile": _fields(
        "company_name=companyName string", "cik string", "sector string", "industry string", "employees=fullTimeEmployees bigint", "ceo string",
        "website string", "description string"),
    "company-notes": _fields("ord=id bigint", "cik string", "title string", "exchange string"),
    "income-statement": _STATEMENT, "balance-sheet-statement": _STATEMENT, "cash-flow-statement": _STATEMENT,
    "key-metrics": _STATEMENT, "ratios": _STATEMENT, "enterprise-values": _STATEMENT,
    "key-metrics-ttm": _POINT, "ratios-ttm": _POINT, "news/stock": _POINT, "news/press-releases": _POINT, "analyst-estimates": _POINT,
    "insider-trading/search": _POINT, "insider-trading/statistics": _POINT,
    "ipos-disclosure": _fields("ord=id bigint", "form string", "symbol string", "ticker string", "companySymbol string", "stock string", "cik string"),
    "ipos-prospectus": _fields("ord=id bigint", "form string", "symbol string", "ticker string", "companySymbol string", "stock string", "cik string"),
    "stock-peers": _fields("peer=symbol string", "brand=companyName string"),
    "key-executives": _fields("name string", "title string", "pay double"),
    "shares-float": _fields("date date", "free_float=freeFloat double", "float_shares=floatShares bigint", "outstanding=outstandingShares bigint"),
    "quote": _fields("price double", "change double", "volume bigint", "market_cap=marketCap bigint"),
    "financial-scores": _fields("altman_z=altmanZScore double", "piotroski=piotroskiScore int"),
    "price-target-summary": _fields("targets=lastMonthCount bigint", "average=lastMonthAvgPriceTarget double"),
    "price-target-consensus": _fields("high=targetHigh double", "low=targetLow double", "consensus=targetConsensus double"),
    "ratings-snapshot": _fields("rating string", "score=overallScore int"),
    "sec-filings-search/symbol": _fields("ord=id bigint", "date=filingDate date", "form=formType string"),
    "revenue-product-segmentation": _POINT, "revenue-geographic-segmentation": _POINT,
    "treasury-rates": _POINT, "market-risk-premium": _POINT, "economic-calendar": _POINT, "economic-indicators": (Field("name", "name", "string"), *_POINT),
    "sector-performance-snapshot": _POINT, "industry-performance-snapshot": _POINT, "sector-pe-snapshot": _POINT, "industry-pe-snapshot": _POINT,
    "historical-sector-performance": (Field("name", "sector", "string"), *_POINT),
    "historical-industry-performance": (Field("name", "industry", "string"), *_POINT),
    "etf/sector-weightings": _POINT, "batch-quote": (Field("name", "symbol", "string"), *_POINT),
    "historical-price-eod/full": _fields(
        "ord=id bigint", "date date", "close double", "adj_close=adjClose double", "volume bigint", "change_percent=changePercent double"),
}
