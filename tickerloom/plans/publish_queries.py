"""Publishing and sink plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.collections import strict_json
from tickerloom.operators import publish as p
from tickerloom.operators import sinks
from tickerloom.plans.registry import iso, query
from tickerloom.plans.source_queries import _REPORT_KEYS
from tickerloom.plans.views import Views
from tickerloom.session import scratch_dir
from tickerloom.sources.artifacts import parse_report_keys

C_REPORTS = "SELECT date, symbol FROM {c_keys} GROUP BY date, symbol"
C_TOP = """
SELECT *, ROW_NUMBER() OVER (ORDER BY date DESC, symbol DESC) - 1 AS weight
FROM (SELECT * FROM {c_reports} ORDER BY date DESC, symbol DESC LIMIT 50) t"""
TOP = {"c_keys": _REPORT_KEYS, "c_reports": C_REPORTS, "c_top": C_TOP}


def reports_of(v: Views):
    """Distinct stored reports (an object key exists once)."""
    return parse_report_keys(v.v_keys).select("date", "symbol").distinct()


@query("p01_newest_reports", "SELECT date, symbol, weight FROM {c_top}", **TOP)
def p01(v):
    return p.newest_reports(reports_of(v)).select("date", "symbol", F.col("weight").cast("long").alias("weight"))


@query("p02_front_matter", """
SELECT symbol || ' · IPO 研报' AS title, symbol, date AS report_date, date || 'T00:00:00Z' AS date,
  date || '-' || regexp_replace(symbol, '[^A-Za-z0-9._-]', '_', 'g') AS slug, weight,
  '/reports/' || date || '-' || regexp_replace(symbol, '[^A-Za-z0-9._-]', '_', 'g') || '/' AS url_path FROM {c_top}""", **TOP)
def p02(v):
    return p.front_matter(p.newest_reports(reports_of(v))).withColumn("weight", F.col("weight").cast("long"))


@query("p03_pages", """
SELECT symbol, date, CAST(floor(weight / 20) + 1 AS BIGINT) AS page, CAST(ceil(n / 20) AS BIGINT) AS page_count,
  COUNT(*) OVER (PARTITION BY floor(weight / 20)) AS rows_on_page
FROM (SELECT *, COUNT(*) OVER () AS n FROM {c_top}) t""", **TOP)
def p03(v):
    rows = p.paginate(p.newest_reports(reports_of(v)))
    return rows.select("symbol", "date", F.col("page").cast("long").alias("page"),
                       F.col("page_count").cast("long").alias("page_count"), "rows_on_page")


C_RATED = """
SELECT CASE WHEN json_valid(metrics_json) THEN metrics_json->>'$.subscription_recommendation' END AS rating,
  CASE WHEN json_valid(metrics_json) THEN metrics_json->>'$.sector' END AS sector,
  CASE WHEN json_valid(metrics_json) THEN metrics_json->>'$.market' END AS market FROM {v_metrics}"""


@query("p04_facets", """
SELECT CASE WHEN GROUPING(rating) = 0 THEN 'rating' WHEN GROUPING(sector) = 0 THEN 'sector' ELSE 'market' END AS facet,
  coalesce(rating, sector, market, '(none)') AS value, COUNT(*) AS reports
FROM {c_rated} GROUP BY GROUPING SETS ((rating), (sector), (market))""", c_rated=C_RATED)
def p04(v):
    body = F.when(strict_json(F.col("metrics_json")), F.col("metrics_json"))
    rated = v.v_metrics.select(*[
        F.get_json_object(body, f"$.{k}").alias(n)
        for n, k in (("rating", "subscription_recommendation"), ("sector", "sector"), ("market", "market"))])
    return p.facets(rated).withColumn("value", F.coalesce("value", F.lit("(none)")))


@query("p05_timeline", """
SELECT symbol, CAST(date AS STRING) AS date, family, ref,
  ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date, family, ref) AS position FROM (
  SELECT symbol, date, 'calendar' AS family, CAST(ord AS STRING) AS ref FROM {v_calendar} WHERE symbol <> '' AND date IS NOT NULL
  UNION ALL SELECT symbol, CAST(date AS DATE), 'report', key || CAST(ord AS STRING) FROM {c_keys}
  UNION ALL SELECT symbol, date, 'metrics', CAST(ord AS STRING) FROM {v_metrics}
  UNION ALL SELECT symbol, date, 'filing', CAST(ord AS STRING) FROM {v_filings}) t""", c_keys=_REPORT_KEYS)
def p05(v):
    def family(df, name, ref):
        return df.select("symbol", F.col("date").cast("date").alias("date"), F.lit(name).alias("family"), ref.alias("ref"))

    ord_text = F.col("ord").cast("string")
    rows = p.timeline(
        family(v.v_calendar.where("symbol <> '' and date is not null"), "calendar", ord_text),
        family(parse_report_keys(v.v_keys), "report", F.concat("key", ord_text)),
        family(v.v_metrics, "metrics", ord_text),
        family(v.v_filings, "filing", ord_text),
    )
    return rows.select("symbol", iso("date"), "family", "ref", "position")


@query("k01_upsert", """
SELECT CAST(month AS STRING) AS date, symbol, arg_max(body, ord) AS body FROM (
  SELECT CAST(date_trunc('month', date) AS DATE) AS month, symbol, ord,
    CASE WHEN metrics_json IS NULL THEN 'refetched ' || CAST(ord AS STRING) ELSE metrics_json END AS body
  FROM {c_last}) t GROUP BY month, symbol""", c_last="""
SELECT * FROM {v_metrics} QUALIFY ROW_NUMBER() OVER (PARTITION BY date_trunc('month', date), symbol ORDER BY ord DESC) = 1""")
def k01(v):
    path = scratch_dir(v.spark, "upsert")
    monthly = v.v_metrics.select(
        F.trunc("date", "month").alias("date"), "symbol", "ord", F.col("metrics_json").alias("body"))
    sinks.upsert(monthly, path, order="ord")
    last = sinks.latest_per_key(monthly, "ord")
    again = last.where("body is null").withColumn("body", F.concat(F.lit("refetched "), F.col("ord").cast("string")))
    sinks.upsert(again.select("date", "symbol", "body"), path)
    return v.spark.read.parquet(path).select(iso("date"), "symbol", "body")


_FAMILY_ROWS = " UNION ALL ".join(
    f"SELECT ord, '{name}' AS family, '{prefix}' || CAST(date AS STRING) || '/' || upper(symbol) || '{suffix}"
    + ("INDEX.md'" if name == "debug" else "'") + " AS key, CAST(date AS STRING) AS date, symbol FROM {c_named}"
    for name, prefix, suffix in fv.KEY_FAMILIES)


@query("k02_key_layout", "SELECT * FROM (" + _FAMILY_ROWS + ") t",
       c_named="SELECT * FROM {v_calendar} WHERE symbol <> '' AND date IS NOT NULL")
def k02(v):
    named = v.v_calendar.where("symbol <> '' and date is not null").select("ord", "symbol", iso("date"))
    families = F.explode(F.array(*[F.lit(name) for name, _, _ in fv.KEY_FAMILIES])).alias("kind")
    keys = named.select("ord", "symbol", "date", families).select(
        "ord", p.storage_key(F.col("kind"), F.col("date"), F.col("symbol"), F.lit("/INDEX.md")).alias("key"))
    return p.parse_storage_key(keys).select("ord", "family", "key", "date", "symbol")


@query("k02_free_keys", f"""
SELECT ord, 'shared_bundle' AS family, '{fv.SHARED_BUNDLE_PREFIX}' || CAST(date AS STRING) || '/{fv.SHARED_BUNDLE_NAME}' AS key, CAST(date AS STRING) AS date,
  '' AS prompt, '' AS version FROM {{c_named}}
UNION ALL SELECT ord, 'deviation_history', '{fv.DEVIATION_HISTORY_KEY}', '', '', '' FROM {{c_named}}
UNION ALL SELECT ord, 'prompt_version', '{fv.PROMPT_VERSIONS_PREFIX}' || regexp_replace(company, '[^A-Za-z0-9._-]', '_', 'g') || '_' || strftime(date, '%Y%m%d')
  || 'T000000{fv.PROMPT_VERSION_SUFFIX}', '', regexp_replace(company, '[^A-Za-z0-9._-]', '_', 'g'), CAST(date AS STRING) || ' 00:00:00' FROM {{c_named}}
UNION ALL SELECT ord, '', 'state/evolution/prompt_versions/' || symbol, '', '', '' FROM {{c_named}}""",
       c_named="SELECT * FROM {v_calendar} WHERE company IS NOT NULL AND date IS NOT NULL AND symbol <> ''")
def k02_free(v):
    named = v.v_calendar.where("company is not null and date is not null and symbol <> ''")
    key = F.explode(F.array(
        p.shared_bundle_key(F.col("date").cast("string")), p.history_key(), p.prompt_version_key(F.col("company"), F.col("date").cast("timestamp")),
        F.concat(F.lit(fv.PROMPT_VERSIONS_PREFIX), "symbol")))
    rows = p.parse_free_key(named.select("ord", key.alias("key")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("ord", blank(F.col("family")).alias("family"), "key", blank(F.col("date")).alias("date"), blank(F.col("prompt")).alias("prompt"),
                       blank(F.date_format("version", "yyyy-MM-dd HH:mm:ss")).alias("version"))


@query("k03_json_sink", """
SELECT to_json(struct_pack(ord := ord, symbol := symbol, day := CAST(date AS STRING), label := '研报 ' || company, cik := cik,
  shares := shares)) AS json FROM {v_calendar}""")
def k03(v):
    rows = v.v_calendar.select(
        "ord", "symbol", F.col("date").alias("day"), F.concat(F.lit("研报 "), F.col("company")).alias("label"), "cik", "shares")
    return sinks.json_lines(rows)
