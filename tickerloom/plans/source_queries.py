"""Scans, payload normalisation and scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import scalars as sc
from tickerloom.operators.deviation import read_forecasts
from tickerloom.plans.registry import iso, query
from tickerloom.plans.silver import SilverViews
from tickerloom.plans.views import RUN_DATE, Views
from tickerloom.session import scratch_dir
from tickerloom.sources import artifacts, landed, scans


@query("s01_ipo_calendar", """
SELECT ord, symbol, CAST(date AS STRING) AS date, exchange, coalesce(shares, -1) AS shares FROM {v_calendar}
WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""")
def s01(v):
    rows = scans.calendar_between(SilverViews(v).lookup("v_calendar"), "1997-01-01", "2000-12-31")
    return rows.select("ord", "symbol", iso("date"), "exchange", F.coalesce("shares", F.lit(-1)).alias("shares"))


@query("s02_symbol_dataset", """
SELECT symbol, ord, rank FROM (
  SELECT symbol, ord, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC NULLS LAST, ord) AS rank
  FROM {v_eod} WHERE symbol IN (SELECT symbol FROM {v_profile})) t WHERE rank <= 72""")
def s02(v):
    requested = v.v_profile.select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"))
    rows = scans.for_symbols(v.v_eod, requested, order=[F.col("date").desc_nulls_last(), F.col("ord")], limit=72)
    return rows.select("symbol", "ord", F.col("rank").cast("long").alias("rank"))


@query("s03_period_table", """
SELECT symbol, statement, CAST(date AS STRING) AS date, revenue, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, statement ORDER BY date DESC, ord) AS rank
  FROM {v_financials} WHERE period = 'annual') t WHERE rank <= 6""")
def s03(v):
    rows = scans.period_table(v.v_financials, "annual", 6, keys=("symbol", "statement"))
    return rows.select("symbol", "statement", iso("date"), "revenue", F.col("rank").cast("long").alias("rank"))


@query("s04_window_page", """
SELECT symbol, ord, CAST(date AS STRING) AS date, form, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC, ord) AS rank FROM {v_filings}
  WHERE date BETWEEN DATE '1999-02-01' AND DATE '2001-01-31') t WHERE rank > 40 AND rank <= 80""")
def s04(v):
    filings = SilverViews(v).lookup("v_filings") if type(v) is Views else v.v_filings
    rows = scans.window_page(filings, "1999-02-01", RUN_DATE, page=1, limit=40)
    return rows.select("symbol", "ord", iso("date"), "form", F.col("rank").cast("long").alias("rank"))


@query("s05_day_snapshot", """
SELECT level, name, CAST(date AS STRING) AS date, value FROM {v_series} WHERE date = DATE '2001-01-31'""")
def s05(v):
    return scans.day_snapshot(v.v_series, RUN_DATE).select("level", "name", iso("date"), "value")


@query("s06_batch_lookup", """
SELECT symbol, ord, CAST(date AS STRING) AS date, close FROM {v_eod} WHERE symbol IN ('SPY', 'S1', 'S42')""")
def s06(v):
    rows = scans.batch_lookup(SilverViews(v).lookup("v_eod"), ["spy", " s1 ", "S42", "", "  "])
    return rows.select("symbol", "ord", iso("date"), "close")


@query("s07_named_series", """
SELECT name, CAST(date AS STRING) AS date, value FROM {v_series} WHERE level = 'sector' AND name = 'ASIA'""")
def s07(v):
    return scans.named_series(v.v_series, "sector", " ASIA ").select("name", iso("date"), "value")


_REPORT_KEYS = """
SELECT ord, key, regexp_extract(key, '^reports/(\\d{{4}}-\\d{{2}}-\\d{{2}})/([^/]+)_report\\.md$', 1) AS date,
  regexp_extract(key, '^reports/(\\d{{4}}-\\d{{2}}-\\d{{2}})/([^/]+)_report\\.md$', 2) AS symbol
FROM {v_keys} WHERE regexp_matches(key, '^reports/(\\d{{4}}-\\d{{2}}-\\d{{2}})/([^/]+)_report\\.md$')"""


@query("s08_artifact_listing", "SELECT * FROM {c_keys}", c_keys=_REPORT_KEYS)
def s08(v):
    return artifacts.parse_report_keys(v.v_keys).select("ord", "key", "date", "symbol")


@query("s09_document_read", """
SELECT doc_id, length(text) + 2 AS n_chars, md5(chr(65533) || text || chr(65533)) AS digest FROM {documents}""")
def s09(v):
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    text = artifacts.decode_utf8(broken)
    return v.documents.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


_DAYS = """SELECT CAST(run_date AS STRING) AS date, symbol, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM {v_files}
WHERE text IS NOT NULL GROUP BY run_date, symbol"""


def stored_files(v: Views) -> str:
    """The documents written as files below the scratch folder."""
    root = scratch_dir(v.spark, "documents")
    artifacts.write_documents(v.v_files.where("text IS NOT NULL"), root)
    return root


@query("s08_listed_files", """
SELECT date, symbol, CAST(octet_length(encode(body)) AS BIGINT) AS length FROM {c_days} WHERE date LIKE '2024-01-1%'""", c_days=_DAYS)
def s08_files(v):
    """Files of ten days, listed by prefix without reading one."""
    listed = artifacts.list_artifacts(v.spark, stored_files(v), "run_date=2024-01-1")
    part = lambda name: F.regexp_extract("key", f"{name}=([^/]+)/", 1).alias(name)
    return listed.where("key LIKE '%.txt'").select(part("run_date").alias("date"), part("symbol"), "length")


@query("s09_read_files", "SELECT date, symbol, length(body) AS n_chars, md5(body) AS digest FROM {c_days}", c_days=_DAYS)
def s09_files(v):
    """Every file read back whole."""
    read = artifacts.read_documents(v.spark, stored_files(v)).where("key LIKE '%.txt'")
    part = lambda name: F.regexp_extract("key", f"{name}=([^/]+)/", 1)
    return read.select(part("run_date").alias("date"), part("symbol").alias("symbol"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


C_FORECASTS = """
SELECT r.symbol, r.metrics_date,
  CASE WHEN metrics_json IS NULL THEN 'missing_metrics' WHEN NOT json_valid(metrics_json) THEN 'invalid_metrics'
    WHEN json_type(metrics_json) <> 'OBJECT' THEN 'invalid_metrics' END AS metrics_error,
  CASE WHEN json_valid(metrics_json) THEN CAST(metrics_json->>'$.predicted_price' AS DOUBLE) END AS predicted_price,
  CASE WHEN json_valid(metrics_json) THEN CAST(metrics_json->>'$.confidence' AS DOUBLE) END AS confidence
FROM {v_requests} r LEFT JOIN {v_metrics} m ON r.symbol = m.symbol AND r.metrics_date = m.date"""


@query("s10_stored_metrics", """
SELECT symbol, CAST(metrics_date AS STRING) AS metrics_date, metrics_error, predicted_price, confidence
FROM {c_f}""", c_f=C_FORECASTS)
def s10(v):
    rows = read_forecasts(v.v_requests.select("symbol", "metrics_date"), v.v_metrics)
    return rows.select("symbol", iso("metrics_date"), "metrics_error", "predicted_price", "confidence")


# --- landed payloads ------------------------------------------------------------

C_PARSED = """
SELECT *, CASE WHEN payload IS NOT NULL AND p IS NULL THEN 'invalid_json'
    WHEN kind = 'OBJECT' AND vendor IS NOT NULL THEN 'vendor_error: ' || vendor END AS parse_error
FROM (SELECT *, json_type(p) AS kind,
  coalesce(nullif(p->>'$."Error Message"', ''), nullif(p->>'$.error', '')) AS vendor,
  CASE WHEN json_type(p) = 'ARRAY' THEN json_array_length(p) END AS n,
  CASE WHEN json_type(p) = 'ARRAY'
    THEN len(list_filter(json_extract(p, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) END AS n_bad,
  CASE WHEN json_type(p, '$.historical') = 'ARRAY' THEN json_array_length(p, '$.historical') END AS n_hist
  FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS p FROM {v_landed}) a) b"""


@query("n01_list_rows", """
SELECT event_id, dataset, row_error, CASE WHEN row_error IS NOT NULL THEN 0 WHEN kind = 'OBJECT' THEN 1
  WHEN kind = 'ARRAY' THEN CAST(n AS BIGINT) ELSE 0 END AS n_rows
FROM (SELECT *, CASE WHEN parse_error IS NOT NULL THEN parse_error WHEN n_bad > 0 THEN 'non_object_entries'
  WHEN kind NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN 'unexpected_type' END AS row_error FROM {c_p}) t""", c_p=C_PARSED)
def n01(v):
    rows = landed.list_rows(v.v_landed)
    return rows.select("event_id", "dataset", "row_error", F.size("rows").cast("long").alias("n_rows"))


@query("n02_historical_rows", """
SELECT event_id, row_error, CASE WHEN row_error IS NOT NULL THEN 0 ELSE CAST(coalesce(n, n_hist) AS BIGINT) END AS n_rows
FROM (SELECT *, CASE WHEN parse_error IS NOT NULL THEN parse_error WHEN coalesce(n, n_hist) IS NULL THEN 'unexpected_shape'
  WHEN n_bad > 0 THEN 'non_object_entries' END AS row_error FROM {c_p}) t""", c_p=C_PARSED)
def n02(v):
    rows = landed.historical_rows(v.v_landed)
    return rows.select("event_id", "row_error", F.size("rows").cast("long").alias("n_rows"))


@query("n03_error_payloads", """
SELECT CASE WHEN parse_error IS NULL THEN 'accepted' ELSE 'quarantined' END AS side, dataset,
  coalesce(parse_error, '') AS reason, COUNT(*) AS n FROM {c_p} GROUP BY ALL""", c_p=C_PARSED)
def n03(v):
    good, bad = landed.split_vendor_errors(v.v_landed)
    both = good.withColumn("side", F.lit("accepted")).unionByName(bad.withColumn("side", F.lit("quarantined")))
    return both.groupBy("side", "dataset", F.coalesce("parse_error", F.lit("")).alias("reason")).agg(
        F.count("*").alias("n"))


@query("n04_lenient_rows", """
SELECT event_id, CASE WHEN parse_error IS NOT NULL THEN 0 WHEN kind = 'OBJECT' THEN 1 WHEN kind = 'ARRAY'
  THEN CAST(n AS BIGINT) ELSE 0 END AS n_rows FROM {c_p}""", c_p=C_PARSED)
def n04(v):
    return landed.lenient_rows(v.v_landed).select("event_id", F.size("rows").cast("long").alias("n_rows"))


@query("n05_fetch_status", """
SELECT dataset, CASE WHEN http_status IS NULL OR http_status = 429 OR http_status >= 500 THEN 'retryable'
  WHEN http_status >= 400 THEN 'fatal' ELSE 'ok' END AS class, COUNT(*) AS n FROM {v_landed} GROUP BY 1, 2""")
def n05(v):
    return landed.fetch_summary(v.v_landed)


# --- scalars ----------------------------------------------------------------------

@query("n06_symbol", "SELECT ord, nullif(upper(trim(symbol)), '') AS symbol FROM {v_calendar}")
def n06(v):
    raw = F.concat(F.lit("\t "), F.lower("symbol"), F.lit(" \n"))
    return v.v_calendar.select("ord", sc.normalize_symbol(raw).alias("symbol"))


_CIK = """CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'none', 'null') THEN NULL
  WHEN regexp_matches(trim({c}), '^[0-9]+$') AND length(trim({c})) < 10 THEN lpad(trim({c}), 10, '0')
  ELSE trim({c}) END"""


@query("n07_cik", f"SELECT symbol, {_CIK.format(c='cik')} AS cik FROM {{v_profile}} UNION ALL "
                  f"SELECT symbol, {_CIK.format(c='cik')} AS cik FROM {{v_calendar}}")
def n07(v):
    both = v.v_profile.select("symbol", "cik").unionByName(v.v_calendar.select("symbol", "cik"))
    return both.select("symbol", sc.normalize_cik(F.col("cik")).alias("cik"))


@query("n08_iso_day", """
SELECT o_orderkey AS ord, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}""")
def n08(v):
    return v.orders.select(F.col("o_orderkey").alias("ord"), sc.iso_day(F.col("o_orderdate")).alias("day"))


C_EXPECTED = """
SELECT *, CASE WHEN regexp_matches(h, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(h AS DATE)
  WHEN regexp_matches(h, '^\\d{{8}}$')
  THEN try_cast(substr(h, 1, 4) || '-' || substr(h, 5, 2) || '-' || substr(h, 7, 2) AS DATE) END AS expected
FROM (SELECT *, substr(trim(expected_date), 1, 10) AS h FROM {v_calendar}) t"""


@query("n09_tolerant_date", "SELECT ord, CAST(expected AS STRING) AS expected FROM {c_e}", c_e=C_EXPECTED)
def n09(v):
    return v.v_calendar.select("ord", sc.parse_iso_date(F.col("expected_date")).cast("string").alias("expected"))


@query("n10_sector_label", """
SELECT symbol, nullif(trim(coalesce(nullif(sector, ''), sector_formatted)), '') AS sector,
  nullif(trim(coalesce(nullif(industry, ''), industry_formatted)), '') AS industry FROM {v_profile}""")
def n10(v):
    return v.v_profile.select(
        "symbol",
        sc.clean_label(F.col("sector"), F.col("sector_formatted")).alias("sector"),
        sc.clean_label(F.col("industry"), F.col("industry_formatted")).alias("industry"))


@query("n11_first_nonblank", """
SELECT symbol, coalesce(nullif(trim(sector), ''), nullif(trim(industry), ''), nullif(trim(cik), '')) AS label
FROM {v_profile}""")
def n11(v):
    label = sc.first_nonblank(F.col("sector"), F.col("industry"), F.col("cik"))
    return v.v_profile.select("symbol", label.alias("label"))


@query("n13_shorten", """
SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short FROM {documents}""")
def n13(v):
    return v.documents.select("doc_id", sc.shorten(F.col("text")).alias("short"))


@query("n14_slug", """
SELECT ord, regexp_replace(key, '[^A-Za-z0-9._-]', '_', 'g') AS slug,
  CAST(date AS STRING) || '-' || regexp_replace(symbol, '[^A-Za-z0-9._-]', '_', 'g') AS basename FROM {c_keys}""",
       c_keys=_REPORT_KEYS)
def n14(v):
    rows = artifacts.parse_report_keys(v.v_keys)
    return rows.select("ord", sc.safe_slug(F.col("key")).alias("slug"),
                       sc.report_basename(F.col("date"), F.col("symbol")).alias("basename"))


@query("n15_truncate", """
SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '[TRUNCATED — original '
  || CAST(length(text) AS STRING) || ' chars]' ELSE text END) AS digest FROM {documents}""")
def n15(v):
    return v.documents.select("doc_id", F.md5(sc.truncate_with_note(F.col("text"), 1000)).alias("digest"))
