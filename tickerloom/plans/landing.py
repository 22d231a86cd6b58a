"""A landing zone made from the test views, and the views read back from it.

Each view's rows are written as vendor payloads (JSON text, one per request: a company, a series, a year), with fields that no rule
knows and values that do not fit their type.  Reading them back through the typed rows must give the same tables, so every plan over
the views has a twin over landed JSON with the same check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.views import Views
from tickerloom.session import materialize
from tickerloom.sources.typed import Typed, typed_rows

STATEMENTS = {
    "income_statement": "income-statement", "balance_sheet": "balance-sheet-statement", "cash_flow": "cash-flow-statement",
    "key_metrics": "key-metrics", "ratios": "ratios", "enterprise_values": "enterprise-values",
}
NEWS = {
    "stock_news": "news/stock", "press_releases": "news/press-releases", "analyst_estimates_annual": "analyst-estimates",
    "insider_trades_search": "insider-trading/search",
}
MACRO = {
    "treasury_rates": "treasury-rates", "economic_calendar": "economic-calendar", "economic_indicators": "economic-indicators",
    "sector_performance_snapshot": "sector-performance-snapshot", "industry_performance_snapshot": "industry-performance-snapshot",
    "sector_pe_snapshot": "sector-pe-snapshot", "industry_pe_snapshot": "industry-pe-snapshot", "etf_sector_weightings_spy": "etf/sector-weightings",
    "major_index_batch_quotes": "batch-quote", "market_risk_premium": "market-risk-premium",
}
_NAMED = ("economic_indicators", "major_index_batch_quotes")
_SNAPSHOTS = [d for p, d in MACRO.items() if p not in (*_NAMED, "market_risk_premium")]


def _named(column: str, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(column))


def _payloads(rows: DataFrame, dataset: Column, page: Column, fields: dict[str, Column], wrap: bool = False) -> DataFrame:
    """(symbol, dataset, http_status, payload): a page of a company's rows as one payload."""
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    listed = F.sort_array(F.collect_list(row))
    body = F.struct(F.col("symbol"), listed.alias("historical")) if wrap else listed
    return rows.groupBy("symbol", dataset.alias("dataset"), page.alias("page")).agg(F.to_json(body).alias("payload")).select(
        "symbol", "dataset", F.lit(200).alias("http_status"), "payload")


def _year(day: str = "date") -> Column:
    return F.coalesce(F.year(day), F.lit(0))


def _day() -> Column:
    return F.col("date").cast("string")


def landed_prices(v: Views) -> DataFrame:
    odd = F.when(F.col("ord") % 40 == 1, "n/a").otherwise((F.col("ord") % 7).cast("string"))
    return _payloads(
        v.v_eod, F.lit("historical-price-eod/full"), F.floor(F.col("ord") / 10000),
        {"id": F.col("ord"), "date": _day(), "close": F.col("close"), "adjClose": F.col("adj_close"), "volume": F.col("qty"), "changePercent": odd, "label": F.concat(F.lit("day "), F.col("ord"))}, wrap=True)


def landed_statements(v: Views) -> DataFrame:
    return _payloads(
        v.v_financials.where(F.col("statement").isin(*STATEMENTS)), _named("statement", STATEMENTS), _year(),
        {"id": F.col("ord"), "date": _day(), "period": F.col("period"), "revenue": F.col("revenue"), "reportedCurrency": F.lit("USD")})


def landed_news(v: Views) -> DataFrame:
    return _payloads(
        v.v_news.where(F.col("field").isin(*NEWS)), _named("field", NEWS), _year(),
        {"id": F.col("ord"), "date": _day(), "value": F.col("value"), "text": F.concat(F.lit("item "), F.col("ord"))})


def landed_filings(v: Views) -> DataFrame:
    return _payloads(
        v.v_filings, F.lit("sec-filings-search/symbol"), _year(), {"id": F.col("ord"), "filingDate": _day(), "formType": F.col("form"), "lines": F.col("n_lines")})


def landed_macro(v: Views) -> DataFrame:
    return _payloads(
        v.v_macro.withColumn("symbol", F.lit(None).cast("string")), _named("part", MACRO), F.struct(_year().alias("year"), "name"),
        {"id": F.col("ord"), "date": _day(), "value": F.col("value"), "name": F.col("name"), "symbol": F.lit(None).cast("string")})


def typed_prices(v: Views) -> Typed:
    return typed_rows(materialize(landed_prices(v), "landed-prices"), "historical-price-eod/full")


def typed_statements(v: Views) -> Typed:
    return typed_rows(materialize(landed_statements(v), "landed-statements"), *STATEMENTS.values(), keep=("symbol", "dataset"))


def _eod(v: Views) -> DataFrame:
    return typed_prices(v).rows.withColumn("qty", F.col("volume")).drop("pos", "volume", "change_percent", "leftover")


def _financials(v: Views) -> DataFrame:
    names = {d: n for n, d in STATEMENTS.items()}
    return typed_statements(v).rows.withColumn("statement", _named("dataset", names)).drop("pos", "dataset", "leftover")


def _news(v: Views) -> DataFrame:
    rows = typed_rows(materialize(landed_news(v), "landed-news"), *NEWS.values(), keep=("symbol", "dataset")).rows
    return rows.withColumn("field", _named("dataset", {d: n for n, d in NEWS.items()})).drop("pos", "dataset", "leftover")


def _filings(v: Views) -> DataFrame:
    rows = typed_rows(materialize(landed_filings(v), "landed-filings"), "sec-filings-search/symbol").rows
    return rows.withColumn("n_lines", F.element_at("leftover", "lines").cast("long")).drop("pos", "leftover")


def _macro(v: Views) -> DataFrame:
    landed = materialize(landed_macro(v), "landed-macro")
    rows = typed_rows(landed, *_SNAPSHOTS, keep=("dataset",)).rows.unionByName(typed_rows(landed, "market-risk-premium", keep=("dataset",)).rows)
    rows = rows.withColumn("name", F.lit(None).cast("string"))
    for part in _NAMED:
        rows = rows.unionByName(typed_rows(landed, MACRO[part], keep=("dataset",)).rows)
    return rows.withColumn("part", _named("dataset", {d: n for n, d in MACRO.items()})).drop("pos", "dataset", "leftover")


class LandedViews(Views):
    """The views, with prices, statements, news, filings and macro rows landed as JSON and read back when first used."""

    READ_BACK = {"v_eod": _eod, "v_financials": _financials, "v_news": _news, "v_filings": _filings, "v_macro": _macro}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.READ_BACK and name not in self._built:
            self._built[name] = self.READ_BACK[name](Views(self.spark, self.folder))
        return super().__getattr__(name)
