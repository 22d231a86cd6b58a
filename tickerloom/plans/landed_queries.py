"""Plans over landed JSON: the typed tables themselves, and twins of plans over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.plans import discovery_queries as dq
from tickerloom.plans import forecast_queries as fq
from tickerloom.plans import record_queries as rq
from tickerloom.plans import source_queries as sq
from tickerloom.plans.landing import MACRO, STATEMENTS, LandedViews, typed_prices, typed_statements
from tickerloom.plans.registry import ORACLES, iso, query


@query("n02_typed_prices", """
SELECT symbol, ord, coalesce(CAST(date AS STRING), '') AS date, close, adj_close, qty AS volume,
  CASE WHEN ord % 40 = 1 THEN NULL ELSE CAST(ord % 7 AS DOUBLE) END AS change_percent, 'day ' || CAST(ord AS STRING) AS label FROM {v_eod}""")
def n02_typed(v):
    rows = typed_prices(v).rows
    label = F.element_at("leftover", "label")
    return rows.select("symbol", "ord", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "close", "adj_close", "volume", "change_percent", label.alias("label"))


@query("n02_typed_quarantine", """
SELECT symbol, 'changePercent' AS field, 'double' AS wanted, '"n/a"' AS found, COUNT(*) AS n FROM {v_eod} WHERE ord % 40 = 1 GROUP BY symbol""")
def n02_cells(v):
    return typed_prices(v).cells.groupBy("symbol", "field", "wanted", "found").agg(F.count("*").alias("n"))


_KNOWN = ", ".join(f"'{s}'" for s in STATEMENTS)


@query("n01_typed_statements", f"""
SELECT symbol, statement, period, CAST(date AS STRING) AS date, ord, revenue, 'USD' AS currency FROM {{v_financials}} WHERE statement IN ({_KNOWN})""")
def n01_typed(v):
    rows = typed_statements(v).rows
    names = F.create_map(*[F.lit(x) for n, d in STATEMENTS.items() for x in (d, n)])
    return rows.select(
        "symbol", F.element_at(names, F.col("dataset")).alias("statement"), "period", iso("date"), "ord", "revenue", F.element_at("leftover", "reportedCurrency").alias("currency"))


@query("n01_typed_news", "SELECT symbol, field, CAST(date AS STRING) AS date, ord, value FROM {v_news} WHERE field <> 'unused'")
def n01_news(v):
    return LandedViews(v.spark, v.folder).v_news.select("symbol", "field", iso("date"), "ord", "value")


@query("n01_typed_filings", "SELECT symbol, CAST(date AS STRING) AS date, ord, form, n_lines FROM {v_filings}")
def n01_filings(v):
    return LandedViews(v.spark, v.folder).v_filings.select("symbol", iso("date"), "ord", "form", "n_lines")


_PARTS = ", ".join(f"'{p}'" for p in MACRO)


@query("n01_typed_macro", f"""
SELECT part, coalesce(name, '') AS name, ord, coalesce(CAST(date AS STRING), '') AS date, value FROM {{v_macro}} WHERE part IN ({_PARTS})""")
def n01_macro(v):
    return LandedViews(v.spark, v.folder).v_macro.select("part", F.coalesce("name", F.lit("")).alias("name"), "ord", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "value")


def _twin(name: str, of: str, plan) -> None:
    """The same plan and check, the views read back from landed JSON."""
    query(name)(lambda v: plan(LandedViews(v.spark, v.folder)))
    ORACLES[name] = ORACLES[of]


_twin("s02_landed_symbol_dataset", "s02_symbol_dataset", sq.s02)
query("s03_landed_period_table", """
SELECT symbol, statement, CAST(date AS STRING) AS date, revenue, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, statement ORDER BY date DESC, ord) AS rank
  FROM {v_financials} WHERE period = 'annual' AND statement <> 'other') t WHERE rank <= 6""")(lambda v: sq.s03(LandedViews(v.spark, v.folder)))
_twin("s04_landed_window_page", "s04_window_page", sq.s04)
_twin("j08_landed_window_prices", "j08_window_prices", dq.j08)
_twin("j10_landed_recent_filings", "j10_recent_filings", dq.j10)
_twin("e02_landed_asof_price", "e02_asof_price", fq.e02)
_twin("e05_landed_evaluate_batch", "e05_evaluate_batch", fq.e05)
_twin("a02_landed_macro_trimmed", "a02_macro_trimmed", rq.a02)
_twin("a04_landed_research_record", "a04_research_record", rq.a04)
