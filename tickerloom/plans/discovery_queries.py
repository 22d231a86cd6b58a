"""Discovery, matching and enrichment plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.operators import discovery as d
from tickerloom.plans.registry import iso, query
from tickerloom.plans.source_queries import _CIK, C_EXPECTED
from tickerloom.plans.views import RUN_DATE, Views
from tickerloom.session import materialize, scratch_dir

LOOKBACK = 2500


def entries_of(v: Views) -> DataFrame:
    """Every discovered calendar entry up to the run date, numbered by ``entry``."""
    return d.discover(v.v_calendar, RUN_DATE, LOOKBACK).withColumn("entry", F.col("ord"))


def stored_of(v: Views) -> DataFrame:
    """The entries whose records stay stored under (run date, symbol)."""
    return d.stored_entries(d.discover(v.v_calendar, RUN_DATE, LOOKBACK))


C_FOUND = f"""
SELECT * FROM {{v_calendar}} WHERE date BETWEEN CAST(DATE '{RUN_DATE}' - INTERVAL {LOOKBACK} DAY AS DATE)
  AND DATE '{RUN_DATE}' AND symbol <> ''"""
C_ENTRIES = "SELECT * FROM {c_found}"
C_STORED = "SELECT * FROM {c_found} QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ord DESC) = 1"
C_RESOLVED = f"""
SELECT e.*, coalesce({_CIK.format(c='e.cik')}, {_CIK.format(c='p.cik')}) AS resolved_cik
FROM {{c_entries}} e LEFT JOIN {{v_profile}} p ON e.symbol = p.symbol"""
C_WINDOW = f"""
SELECT *, CASE WHEN start >= DATE '{RUN_DATE}' THEN CAST(DATE '{RUN_DATE}' - INTERVAL 120 DAY AS DATE) ELSE start END
  AS window_from FROM (SELECT r.*, CASE WHEN coalesce(r.date, x.expected) IS NULL
    THEN CAST(DATE '{RUN_DATE}' - INTERVAL 420 DAY AS DATE)
    ELSE CAST(coalesce(r.date, x.expected) - INTERVAL 800 DAY AS DATE) END AS start
  FROM {{c_resolved}} r JOIN {{c_expected}} x ON r.ord = x.ord) t"""
ENTRY_CTES = {"c_found": C_FOUND, "c_entries": C_ENTRIES, "c_resolved": C_RESOLVED, "c_expected": C_EXPECTED,
              "c_window": C_WINDOW}
STORED_CTES = {**ENTRY_CTES, "c_entries": C_STORED}


@query("j01_discover", "SELECT ord, symbol, CAST(date AS STRING) AS date FROM {c_found}", c_found=C_FOUND)
def j01(v):
    return d.discover(v.v_calendar, RUN_DATE, LOOKBACK).select("ord", "symbol", iso("date"))


@query("j02_override", """
SELECT symbol, COUNT(*) AS bars FROM {v_eod} WHERE symbol IN ('SPY', 'S7', 'S11') GROUP BY symbol""")
def j02(v):
    chosen = d.override_entries(v.spark, ["spy", "s7", "S11"]).select("symbol")
    return v.v_eod.join(chosen, "symbol").groupBy("symbol").agg(F.count("*").alias("bars"))


_PROCESSED = """SELECT DISTINCT upper(regexp_extract(key, '^reports/(\\d{{4}}-\\d{{2}}-\\d{{2}})/([^/]+)_report\\.md$', 2)) AS symbol
FROM {v_stored_keys} WHERE regexp_matches(key, '^reports/(\\d{{4}}-\\d{{2}}-\\d{{2}})/([^/]+)_report\\.md$')"""


@query("j03_unprocessed", """
SELECT ord, symbol FROM {c_found} WHERE symbol NOT IN (SELECT symbol FROM {c_done})""",
       c_found=C_FOUND, c_done=_PROCESSED)
def j03(v):
    return d.unprocessed(d.discover(v.v_calendar, RUN_DATE, LOOKBACK), v.v_stored_keys).select("ord", "symbol")


@query("j04_cap", "SELECT ord, symbol FROM {c_found} ORDER BY ord LIMIT 50", c_found=C_FOUND)
def j04(v):
    return d.cap(d.discover(v.v_calendar, RUN_DATE, LOOKBACK), 50).select("ord", "symbol")


C_MATCHED = """
SELECT symbol, resolved_cik, list, ord, form FROM (
  SELECT e.symbol, e.resolved_cik, r.list, r.ord, r.form,
    ROW_NUMBER() OVER (PARTITION BY e.symbol, e.resolved_cik, r.list ORDER BY r.ord) AS rank
  FROM (SELECT DISTINCT symbol, resolved_cik FROM {c_resolved}) e JOIN (SELECT list, ord, form, upper(trim(coalesce(nullif(symbol, ''), nullif(ticker, ''),
      nullif(companySymbol, ''), nullif(stock, '')))) AS row_symbol, """ + _CIK.format(c="cik") + """ AS row_cik
    FROM {v_regulatory}) r ON e.symbol = r.row_symbol OR e.resolved_cik = r.row_cik) t WHERE rank <= 60"""


@query("j05_regulatory_match", """
SELECT e.ord AS entry, e.symbol, m.list, m.n, m.matched FROM {c_resolved} e JOIN (
  SELECT symbol, resolved_cik, list, COUNT(*) AS n, md5(string_agg(CAST(ord AS STRING) || ':' || coalesce(form, ''), ',' ORDER BY ord)) AS matched
  FROM {c_matched} GROUP BY symbol, resolved_cik, list) m ON m.symbol = e.symbol AND m.resolved_cik IS NOT DISTINCT FROM e.resolved_cik""",
       **ENTRY_CTES, c_matched=C_MATCHED)
def j05(v):
    """Every entry's matched rows in order, as a count and a digest per list."""
    entries = d.resolve_cik(entries_of(v), v.v_profile).select("entry", "symbol", "resolved_cik")
    matched = d.match_regulatory(entries, v.v_regulatory)
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "form"))), lambda r: F.concat(r["ord"].cast("string"), F.lit(":"), F.coalesce(r["form"], F.lit(""))))
    lists = matched.groupBy(F.col("symbol").alias("_symbol"), F.col("resolved_cik").alias("_cik"), "list").agg(
        F.count("*").alias("n"), F.md5(F.array_join(ordered, ",")).alias("matched"))
    return entries.join(lists, F.expr("symbol = _symbol AND resolved_cik <=> _cik")).select("entry", "symbol", "list", "n", "matched")


@query("j06_resolve_cik", "SELECT ord, symbol, resolved_cik FROM {c_resolved}", c_entries=C_FOUND, c_resolved=C_RESOLVED)
def j06(v):
    found = d.discover(v.v_calendar, RUN_DATE, LOOKBACK)
    return d.resolve_cik(found, v.v_profile).select("ord", "symbol", "resolved_cik")


@query("j07_price_window", f"""
SELECT ord, CAST(window_from AS STRING) AS window_from, '{RUN_DATE}' AS window_to FROM {{c_window}}""",
       c_entries="SELECT * FROM {v_calendar}", c_resolved=C_RESOLVED, c_expected=C_EXPECTED, c_window=C_WINDOW)
def j07(v):
    return d.price_window(v.v_calendar, RUN_DATE).select("ord", iso("window_from"), iso("window_to"))


C_PRICES = f"""
SELECT * FROM (SELECT e.ord AS entry, e.symbol, p.ord, p.date, p.close, p.adj_close,
    ROW_NUMBER() OVER (PARTITION BY e.ord ORDER BY p.date DESC NULLS LAST, p.ord) AS rank
  FROM {{c_window}} e JOIN {{v_eod}} p ON p.symbol = e.symbol
   AND (p.date IS NULL OR p.date BETWEEN e.window_from AND DATE '{RUN_DATE}')) t WHERE rank <= 72"""
C_BENCH = f"""
SELECT * FROM (SELECT e.ord AS entry, e.symbol, p.ord, p.date, p.close,
    ROW_NUMBER() OVER (PARTITION BY e.ord ORDER BY p.date DESC NULLS LAST, p.ord) AS rank
  FROM {{c_window}} e JOIN {{v_eod}} p ON p.symbol = 'SPY'
   AND (p.date IS NULL OR p.date BETWEEN e.window_from AND DATE '{RUN_DATE}')) t WHERE rank <= 72"""


_PRICE_DIGEST = """SELECT '{side}' AS side, entry, symbol, COUNT(*) AS n, CAST(MAX(date) AS STRING) AS newest,
  CAST(SUM(CAST(round(close * 100) AS BIGINT)) AS BIGINT) AS cents, md5(string_agg(CAST(ord AS STRING), ',' ORDER BY rank)) AS listed
FROM {{{rows}}} GROUP BY entry, symbol"""


def _price_digest(lists: DataFrame, *keys: str) -> DataFrame:
    """Size, newest day, sum and digest of price lists."""
    own, zero = F.col("prices"), F.lit(None).cast("long")
    cents = F.filter(F.transform(own, lambda p: F.round(p["close"] * 100).cast("long")), lambda c: c.isNotNull())
    return lists.select(
        *keys, F.size(own).cast("long").alias("n"), F.array_max(F.transform(own, lambda p: p["date"])).cast("string").alias("newest"),
        F.when(F.size(cents) > 0, F.aggregate(cents, F.lit(0).cast("long"), lambda a, c: a + c)).otherwise(zero).alias("cents"),
        F.md5(F.array_join(F.transform(own, lambda p: p["ord"].cast("string")), ",")).alias("listed"))


@query("j08_window_prices", " UNION ALL ".join(
    _PRICE_DIGEST.format(side=side, rows=rows) for side, rows in (("company", "c_prices"), ("benchmark", "c_bench"))),
       **ENTRY_CTES, c_prices=C_PRICES, c_bench=C_BENCH)
def j08(v):
    """Every entry's price lists in order: size, newest day, sum and a digest of the rows.

    Entries carry how many rows their windows hold; a list is cut and digested once for each (symbol, count).
    """
    entries = d.price_window(entries_of(v), RUN_DATE).select("entry", "symbol", "window_from")
    listed = materialize(d.listed_prices(v.v_eod, RUN_DATE), "listed-prices")
    bench = d.with_benchmark_count(entries, listed)
    counts = materialize(bench.select("entry", "symbol", "window_from", F.col("inside").alias("bench_inside")), "window-counts")
    own = d.window_counts(counts, listed)
    company = own.join(_price_digest(d.counted_lists(own, listed), "symbol", "inside"), ["symbol", "inside"])
    shared = counts.where("bench_inside IS NOT NULL")
    lists = shared.select(F.lit(fv.BENCHMARK_SYMBOL).alias("symbol"), F.col("bench_inside").alias("inside"))
    digests = _price_digest(d.counted_lists(lists, listed), "inside").withColumnRenamed("inside", "bench_inside")
    columns = ["entry", "symbol", "n", "newest", "cents", "listed"]
    return company.select(F.lit("company").alias("side"), *columns).unionByName(
        shared.join(digests, "bench_inside").select(F.lit("benchmark").alias("side"), *columns))


C_NAMES = """SELECT symbol, nullif(trim(coalesce(nullif(sector, ''), sector_formatted)), '') AS sector,
  nullif(trim(coalesce(nullif(industry, ''), industry_formatted)), '') AS industry FROM {v_profile}"""
C_TAILS = """
SELECT level, name, COUNT(*) AS n, MIN(ord) AS lo, MAX(ord) AS hi, SUM(value) AS total FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY level, name ORDER BY ord DESC) AS rn FROM {v_series}) t
WHERE rn <= 40 GROUP BY level, name"""


@query("j09_sector_history", """
SELECT e.ord AS entry, e.symbol, n.sector, n.industry, coalesce(CAST(s.n AS BIGINT), 0) AS sector_points, coalesce(s.lo, -1) AS sector_from,
  coalesce(s.total, 0) AS sector_total, coalesce(CAST(i.n AS BIGINT), 0) AS industry_points,
  coalesce(i.hi, -1) AS industry_to
FROM {c_entries} e LEFT JOIN {c_names} n ON e.symbol = n.symbol
LEFT JOIN {c_tails} s ON s.level = 'sector' AND s.name = n.sector
LEFT JOIN {c_tails} i ON i.level = 'industry' AND i.name = n.industry""",
       c_found=C_FOUND, c_entries=C_ENTRIES, c_names=C_NAMES, c_tails=C_TAILS)
def j09(v):
    rows = d.sector_history(entries_of(v), v.v_profile, v.v_series)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(
        "entry", "symbol", "sector", "industry",
        size("sector_history").alias("sector_points"),
        F.coalesce(F.get("sector_history", F.lit(0))["ord"], F.lit(-1)).alias("sector_from"),
        F.coalesce(F.aggregate("sector_history", F.lit(0.0), lambda a, p: a + p["value"]), F.lit(0.0)).alias("sector_total"),
        size("industry_history").alias("industry_points"),
        F.coalesce(F.element_at("industry_history", -1)["ord"], F.lit(-1)).alias("industry_to"),
    )


C_RECENT = f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC, ord) AS rank FROM {{v_filings}}
  WHERE date BETWEEN CAST(DATE '{RUN_DATE}' - INTERVAL {fv.FILINGS_DAYS} DAY AS DATE) AND DATE '{RUN_DATE}') t
WHERE rank <= 40"""


@query("j10_recent_filings", "SELECT symbol, ord, CAST(date AS STRING) AS date, rank FROM {c_recent}", c_recent=C_RECENT)
def j10(v):
    rows = d.recent_filings(v.v_filings, RUN_DATE)
    return rows.select("symbol", "ord", iso("date"), F.col("rank").cast("long").alias("rank"))


@query("j11_peers", """
SELECT e.symbol, e.ord, p.peer, p.brand FROM {c_entries} e LEFT JOIN {v_peers} p ON e.symbol = p.symbol""",
       c_found=C_FOUND, c_entries=C_ENTRIES)
def j11(v):
    return d.with_peers(entries_of(v), v.v_peers).select("symbol", "ord", "peer", "brand")


@query("a08_discovery_summary", f"""
SELECT '{RUN_DATE}' AS discovery_date, COUNT(*) AS count, COUNT(DISTINCT symbol) AS symbols,
  CAST(MIN(date) AS STRING) AS first_date, CAST(MAX(date) AS STRING) AS last_date FROM {{c_found}}""", c_found=C_FOUND)
def a08(v):
    out = d.discovery_summary(d.discover(v.v_calendar, RUN_DATE, LOOKBACK), RUN_DATE)
    return out.select(iso("discovery_date"), "count", "symbols", iso("first_date"), iso("last_date"))


@query("a08_discovery_document", f"""
SELECT '{RUN_DATE}' AS discovery_date, 'entry' AS kind, symbol, ord, coalesce(CAST(date AS STRING), '') AS date, coalesce(company, '') AS company, 1 AS n FROM {{c_found}}
UNION ALL SELECT '{RUN_DATE}', 'symbol', symbol, -1, '', '', COUNT(*) FROM {{c_found}} GROUP BY symbol""", c_found=C_FOUND)
def a08_document(v):
    """Written in pages, read back and taken apart again; each page lists exactly the symbols of its entries."""
    entries = d.discover(v.v_calendar, RUN_DATE, LOOKBACK).select("symbol", "ord", "date", "company", "exchange", "price_range")
    path = scratch_dir(v.spark, "discovery")
    d.write_discovery(entries, path, RUN_DATE)
    pages = d.read_discovery(v.spark, path, entries.schema)
    rows = pages.select("discovery_date", "symbols", F.inline("entries"))
    rows = rows.where(F.array_contains("symbols", F.col("symbol")))
    own = rows.select(
        iso("discovery_date"), F.lit("entry").alias("kind"), "symbol", "ord", F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce("company", F.lit("")).alias("company"), F.lit(1).cast("long").alias("n"))
    counts = rows.groupBy("discovery_date", "symbol").agg(F.count("*").alias("n"))
    return own.unionByName(counts.select(
        iso("discovery_date"), F.lit("symbol").alias("kind"), "symbol", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("date"), F.lit("").alias("company"), "n"))
