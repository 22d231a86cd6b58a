"""IPO-research tables derived from the generic driver tables.

Each view is one SQL text in the dialect Spark and DuckDB share, so a query
and its check start from the same rows.  ``{name}`` refers to a driver table or
to another view.  Every view reads whole tables; the CASE expressions only
shape values (missing, malformed, alternative spellings), they drop no rows.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tickerloom.session import scale_partitions

RUN_DATE = "2001-01-31"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

NL = "chr(10)"


def _join(*parts: str) -> str:
    return " || ".join(parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Integer division that both engines compute exactly.
def _div(a: str, b: str) -> str:
    return f"CAST((({a}) - ({a}) % ({b})) / ({b}) AS BIGINT)"


def _money(cents: str) -> str:
    """Cents as decimal text, e.g. 12345 -> 123.45."""
    return f"CAST({_div(cents, '100')} AS STRING) || '.' || lpad(CAST(({cents}) % 100 AS STRING), 2, '0')"


# Single letters are combined as numbers, which stays in hash aggregation.
def _min_letter(column: str, letters: str) -> str:
    code = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(letters))
    text = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(letters))
    return f"CASE MIN(CASE {column} {code} END) {text} END"


_FLAG = _min_letter("returnflag", "ANR")
_STATUS = _min_letter("linestatus", "FO")

VIEWS: dict[str, str] = {}

# The rows all price, filing and statement views start from, typed once.
VIEWS["v_lines"] = """
SELECT l_orderkey AS orderkey, l_linenumber AS line, l_suppkey AS suppkey, CAST(l_shipdate AS DATE) AS day,
  CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS returnflag,
  l_linestatus AS linestatus
FROM {lineitem}"""

VIEWS["v_order_lines"] = f"""
SELECT orderkey AS ord, MIN(suppkey) AS suppkey, COUNT(*) AS n_lines, {_FLAG} AS flag,
  CAST(SUM(cents) AS BIGINT) AS cents, CAST(SUM(qty) AS BIGINT) AS qty, MIN(day) AS first_ship
FROM {{v_lines}} GROUP BY orderkey"""

VIEWS["v_calendar"] = """
SELECT o_orderkey AS ord,
  CASE WHEN o_orderkey % 29 = 3 THEN NULL WHEN o_orderkey % 29 = 7 THEN ''
       ELSE 'S' || CAST(suppkey AS STRING) END AS symbol,
  CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(first_ship AS STRING) WHEN 1 THEN CAST(first_ship AS STRING) || 'T09:30:00'
       WHEN 2 THEN 'TBD' WHEN 3 THEN '  ' || CAST(first_ship AS STRING) || ' '
       WHEN 4 THEN replace(CAST(first_ship AS STRING), '-', '') ELSE NULL END AS expected_date,
  'Company ' || CAST(suppkey AS STRING) AS company, flag AS exchange,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(suppkey AS STRING) WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE NULL END AS cik,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(n_lines AS STRING) || '-' || CAST(n_lines + 2 AS STRING) END
    AS price_range,
  qty * 1000 AS shares, cents AS market_cap
FROM {orders} LEFT JOIN {v_order_lines} ON ord = o_orderkey"""

VIEWS["v_profile"] = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS symbol, s_name AS company_name,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' null ' WHEN 2 THEN '00' || CAST(s_suppkey AS STRING)
       WHEN 3 THEN 'CIK' || CAST(s_suppkey AS STRING) ELSE CAST(s_suppkey AS STRING) || '00000000000' END AS cik,
  CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE ' ' || r_name || ' ' END AS sector,
  CASE WHEN s_suppkey % 14 = 1 THEN NULL ELSE r_name END AS sector_formatted,
  CASE s_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END AS industry, n_name AS industry_formatted,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey * 10 END AS employees,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'CEO ' || s_name END AS ceo,
  'https://example.com/' || CAST(s_suppkey AS STRING) AS website,
  repeat(s_name || ' in ' || n_name || '. ', CAST(1 + s_suppkey % 5 AS INT)) AS description
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

VIEWS["v_daily"] = """
SELECT suppkey, 'S' || CAST(suppkey AS STRING) AS symbol, day, CAST(SUM(cents) AS BIGINT) AS cents, CAST(SUM(qty) AS BIGINT) AS qty
FROM {v_lines} GROUP BY suppkey, day"""

VIEWS["v_eod_base"] = """
SELECT symbol, day, cents, qty FROM {v_daily}
UNION ALL
SELECT 'SPY' AS symbol, day, CAST(SUM(cents) AS BIGINT) AS cents, CAST(SUM(qty) AS BIGINT) AS qty FROM {v_daily} GROUP BY day"""
VIEWS["v_eod"] = f"""
SELECT symbol, ord, qty,
  CASE WHEN ord % 97 = 11 AND symbol LIKE '%7' THEN NULL ELSE day END AS date,
  CASE WHEN ord % 23 = 0 THEN NULL WHEN ord % 19 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(px AS DOUBLE) / CAST(100 AS DOUBLE) END AS close,
  CASE WHEN ord % 46 = 0 THEN NULL ELSE CAST(px - 1 AS DOUBLE) / CAST(100 AS DOUBLE) END AS adj_close
FROM (SELECT symbol, day, qty, CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT) AS ord,
        {_div('cents', 'qty')} AS px FROM {{v_eod_base}}) b"""

VIEWS["v_requests"] = f"""
SELECT 'S' || CAST(suppkey AS STRING) AS symbol, CAST(o_orderdate AS DATE) AS metrics_date, MIN(ord) AS ord,
  CAST(SUM(cents) AS BIGINT) AS cents, CAST(SUM(qty) AS BIGINT) AS qty, {_min_letter("flag", "ANR")} AS flag
FROM {{orders}} JOIN {{v_order_lines}} ON ord = o_orderkey GROUP BY suppkey, CAST(o_orderdate AS DATE)"""

_PX = f"({_div('cents', 'qty')} * (85 + ord % 31))"
VIEWS["v_metrics"] = f"""
SELECT symbol, metrics_date AS date, ord,
  CASE ord % 41 WHEN 0 THEN NULL WHEN 1 THEN '{{{{bad' WHEN 2 THEN '{{{{"symbol": "' || symbol || '"}}}} trailing'
    WHEN 3 THEN '[]' WHEN 5 THEN '{{{{"symbol": "' || symbol || '", "sector": "Planted", "market": "US"}}}}] trailing' WHEN 6 THEN chr(10) || '{{{{"symbol": "x"}}}}' || chr(10)
    ELSE '{{{{"symbol": "' || symbol || '", "analysis_date": "' || CAST(metrics_date AS STRING) || '", "market": "'
      || CASE ord % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'HK' ELSE 'OTHER' END
      || '", "company_display_name": "Company ' || symbol || '", "confidence": 0.' || CAST(10 + ord % 90 AS STRING)
      || ', "predicted_price": ' || CASE WHEN ord % 37 = 4 THEN 'null' ELSE {_money(_div(_PX, '100'))} END
      || ', "signal": "' || CASE ord % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END
      || '", "risk_score": 0.' || CAST(10 + ord % 80 AS STRING) || ', "sector": "'
      || CASE WHEN ord % 25 = 0 THEN 'Unknown' ELSE 'Sector ' || flag END
      || '", "catalysts_count": ' || CAST(ord % 6 AS STRING) || ', "risks_count": ' || CAST(ord % 7 AS STRING)
      || ', "data_completeness": 0.' || CAST(10 + ord % 70 AS STRING) || ', "subscription_recommendation": "'
      || CASE ord % 4 WHEN 0 THEN 'strong_buy' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'cautious' ELSE 'avoid' END
      || '"}}}}' END AS metrics_json
FROM {{v_requests}}"""

VIEWS["v_keys"] = """
SELECT ord, CASE ord % 11
    WHEN 0 THEN 'reports/' || CAST(date AS STRING) || '/notes.tmp'
    WHEN 1 THEN 'reports/' || CAST(date AS STRING) || '/random.md'
    WHEN 2 THEN 'metrics/' || CAST(date AS STRING) || '/' || symbol || '_metrics.json'
    WHEN 3 THEN 'reports/' || CAST(date AS STRING) || '/a/' || symbol || '_report.md'
    WHEN 4 THEN 'reports/' || replace(CAST(date AS STRING), '-', '') || '/' || symbol || '_report.md'
    WHEN 5 THEN 'critique/' || CAST(date AS STRING) || '/' || symbol || '_critique.md'
    WHEN 6 THEN 'reports/' || CAST(date AS STRING) || '/' || lower(symbol) || '.B C_report.md'
    ELSE 'reports/' || CAST(date AS STRING) || '/' || symbol || '_report.md' END AS key
FROM {v_calendar}"""

# A listing in which part of the companies have a report.
VIEWS["v_stored_keys"] = """
SELECT ord, CASE WHEN length(symbol) % 2 = 0 THEN 'reports/' || CAST(date AS STRING) || '/' || lower(symbol)
  || '_report.md' ELSE 'metrics/' || CAST(date AS STRING) || '/' || symbol || '_metrics.json' END AS key
FROM {v_calendar}"""

VIEWS["v_regulatory"] = f"""
SELECT list, ord, form,
  CASE WHEN ord % 4 = 0 THEN sym WHEN ord % 4 = 1 THEN '' ELSE NULL END AS symbol,
  CASE WHEN ord % 4 = 1 THEN lower(sym) ELSE NULL END AS ticker,
  CASE WHEN ord % 4 = 2 THEN ' ' || sym ELSE NULL END AS companySymbol,
  CASE WHEN ord % 12 = 3 THEN sym ELSE NULL END AS stock,
  CASE ord % 3 WHEN 0 THEN CAST(suppkey AS STRING) WHEN 1 THEN '00' || CAST(suppkey + 1 AS STRING) ELSE NULL END AS cik
FROM (SELECT CASE WHEN line % 2 = 0 THEN 'disclosures' ELSE 'prospectuses' END AS list,
        orderkey * 10 + line AS ord, {_FLAG} AS form, MIN(suppkey) AS suppkey,
        'S' || CAST(MIN(suppkey) AS STRING) AS sym
      FROM {{v_lines}} GROUP BY orderkey, line) r"""

VIEWS["v_financials"] = """
SELECT 'S' || CAST(suppkey AS STRING) AS symbol,
  CASE line WHEN 1 THEN 'income_statement' WHEN 2 THEN 'balance_sheet' WHEN 3 THEN 'cash_flow'
    WHEN 4 THEN 'key_metrics' WHEN 5 THEN 'ratios' WHEN 6 THEN 'enterprise_values' ELSE 'other' END AS statement,
  CASE WHEN returnflag = 'N' THEN 'quarter' ELSE 'annual' END AS period, day AS date, CAST(SUM(cents) AS BIGINT) AS revenue,
  CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT) AS ord
FROM {v_lines} GROUP BY suppkey, line, CASE WHEN returnflag = 'N' THEN 'quarter' ELSE 'annual' END, day"""

VIEWS["v_filings"] = f"""
SELECT 'S' || CAST(suppkey AS STRING) AS symbol, CAST(o_orderdate AS DATE) AS date, orderkey AS ord,
  {_FLAG} || '-' || {_STATUS} AS form, COUNT(*) AS n_lines
FROM {{v_lines}} JOIN {{orders}} ON orderkey = o_orderkey
GROUP BY suppkey, CAST(o_orderdate AS DATE), orderkey"""

VIEWS["v_peers"] = f"""
SELECT 'S' || CAST({_div('p_partkey', '20')} AS STRING) AS symbol, 'P' || CAST(p_partkey AS STRING) AS peer,
  p_brand AS brand
FROM {{part}}"""

VIEWS["v_series"] = """
SELECT level, name, date, item, ord, CAST(cents AS DOUBLE) AS value FROM (
  SELECT 'sector' AS level, r_name AS name, day AS date, r_regionkey AS item,
    CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT) AS ord, CAST(SUM(cents) AS BIGINT) AS cents
  FROM {v_daily} JOIN {supplier} ON suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
    JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey, day
  UNION ALL
  SELECT 'industry' AS level, n_name AS name, day AS date, n_nationkey AS item,
    CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT) AS ord, CAST(SUM(cents) AS BIGINT) AS cents
  FROM {v_daily} JOIN {supplier} ON suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
  GROUP BY n_name, n_nationkey, day) s"""

_DAY_CODE = "CAST(year(day) * 10000 + month(day) * 100 + day(day) AS BIGINT)"
VIEWS["v_macro"] = f"""
SELECT 'treasury_rates' AS part, CAST(NULL AS STRING) AS name, {_DAY_CODE} AS ord, day AS date,
  CAST(cents AS DOUBLE) AS value FROM {{v_eod_base}} WHERE symbol = 'SPY'
UNION ALL
SELECT 'economic_calendar', CAST(NULL AS STRING), MIN(o_orderkey), CAST(o_orderdate AS DATE),
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) FROM {{orders}} GROUP BY CAST(o_orderdate AS DATE)
UNION ALL
SELECT 'economic_indicators', CASE statement WHEN 'income_statement' THEN 'GDP' WHEN 'balance_sheet' THEN 'realGDP'
    WHEN 'cash_flow' THEN 'inflationRate' WHEN 'ratios' THEN 'unemploymentRate' ELSE 'other' END,
  ord, date, CAST(SUM(revenue) AS DOUBLE) FROM {{v_financials}}
GROUP BY CASE statement WHEN 'income_statement' THEN 'GDP' WHEN 'balance_sheet' THEN 'realGDP'
    WHEN 'cash_flow' THEN 'inflationRate' WHEN 'ratios' THEN 'unemploymentRate' ELSE 'other' END, ord, date
UNION ALL
SELECT level || '_performance_snapshot', CAST(NULL AS STRING), ord * 100 + item, date, value FROM {{v_series}}
UNION ALL
SELECT level || '_pe_snapshot', CAST(NULL AS STRING), ord * 100 + item, date, value FROM {{v_series}}
UNION ALL
SELECT 'etf_sector_weightings_spy', CAST(NULL AS STRING), CAST(r_regionkey AS BIGINT), CAST(NULL AS DATE),
  CAST(r_regionkey AS DOUBLE) FROM {{region}}
UNION ALL
SELECT 'major_index_batch_quotes', CAST(NULL AS STRING), CAST(n_nationkey AS BIGINT), CAST(NULL AS DATE), CAST(n_nationkey * 7 AS DOUBLE)
FROM {{nation}} WHERE n_nationkey % 8 = 1
UNION ALL
SELECT 'market_risk_premium', CAST(NULL AS STRING), CAST(n_nationkey AS BIGINT), CAST(NULL AS DATE), CAST(n_nationkey AS DOUBLE) / CAST(4 AS DOUBLE)
FROM {{nation}}"""

_K = "replace(replace(props, '{{\"k\": ', ''), '}}', '')"
VIEWS["v_landed"] = f"""
SELECT event_id, symbol, dataset, http_status, payload FROM (
SELECT event_id, 'S' || CAST(user_id AS STRING) AS symbol,
  CASE event_id % 17 WHEN 0 THEN 'company-notes' WHEN 1 THEN 'key-metrics-ttm' WHEN 2 THEN 'ratios-ttm'
    WHEN 3 THEN 'quote' WHEN 4 THEN 'stock-peers' WHEN 5 THEN 'key-executives' WHEN 6 THEN 'shares-float'
    WHEN 7 THEN 'insider-trading/statistics' WHEN 8 THEN 'price-target-summary' WHEN 9 THEN 'price-target-consensus'
    WHEN 10 THEN 'ratings-snapshot' WHEN 11 THEN 'financial-scores' WHEN 12 THEN 'revenue-product-segmentation'
    WHEN 13 THEN 'revenue-geographic-segmentation' WHEN 14 THEN 'fundraising' WHEN 15 THEN 'historical-price-eod/full'
    ELSE 'ipos-calendar' END AS dataset,
  CASE WHEN event_id % 13 < 9 THEN 200 WHEN event_id % 13 = 9 THEN 429 WHEN event_id % 13 = 10 THEN 503
    WHEN event_id % 13 = 11 THEN 401 ELSE NULL END AS http_status,
  CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN CASE WHEN event_id % 24 = 2 THEN props ELSE props || '] tail' END WHEN 3 THEN '[' || props || ', ' || props || ']'
    WHEN 4 THEN '{{{{"symbol": "S' || CAST(user_id AS STRING) || '", "historical": [{{{{"date": "'
      || CAST(CAST(ts AS DATE) AS STRING) || '", "close": ' || {_K} || '.5}}}}]}}}}'
    WHEN 5 THEN '{{{{"Error Message": "limit reached"}}}}' WHEN 6 THEN '{{{{"error": "rate limited"}}}}'
    WHEN 7 THEN '[' || props || ', 5]' WHEN 8 THEN '42' WHEN 9 THEN '{{{{bad' WHEN 10 THEN '{{{{"error": ""}}}}'
    ELSE '[' || props || ', {{{{"k": null}}}}, ' || props || ']' END AS payload
FROM {{events}}) l"""
VIEWS["v_landed"] = VIEWS["v_landed"].replace("{{{{", "{{").replace("}}}}", "}}")

VIEWS["v_news"] = """
SELECT 'S' || CAST(user_id AS STRING) AS symbol, CASE event_type WHEN 'view' THEN 'stock_news'
    WHEN 'click' THEN 'press_releases' WHEN 'signup' THEN 'analyst_estimates_annual'
    WHEN 'purchase' THEN 'insider_trades_search' ELSE 'unused' END AS field,
  CAST(ts AS DATE) AS date, event_id AS ord, value
FROM {events}"""

VIEWS["v_outcomes"] = """
SELECT run_date, symbol, stage, CAST(ROW_NUMBER() OVER (PARTITION BY run_date, symbol, stage ORDER BY event_id) AS INT)
    AS attempt, event_id % 7 <> 3 AS success,
  CASE WHEN event_id % 7 <> 3 AND stage <> 'reviewer' THEN event_id % 3 <> 1 ELSE NULL END AS gate_passed,
  CASE WHEN event_id % 7 = 3 THEN 'timeout' ELSE NULL END AS error, CAST(value AS DECIMAL(18, 2)) AS duration_seconds
FROM (SELECT event_id, CAST(ts AS DATE) AS run_date, 'S' || CAST(user_id AS STRING) AS symbol, value,
  CASE event_type WHEN 'view' THEN 'drafter' WHEN 'click' THEN 'drafter' WHEN 'signup' THEN 'reviewer'
    ELSE 'reviser' END AS stage FROM {events}) e"""

VIEWS["v_artifacts"] = """
SELECT run_date, symbol, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4000 END AS report_chars,
  CASE WHEN k % 6 = 0 THEN 0 ELSE 13 END AS metrics_fields, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 900 END AS notes_chars,
  CASE WHEN k % 8 = 0 THEN NULL ELSE k % 700 END AS critique_chars,
  CASE WHEN k % 5 = 0 THEN 'drafter/_progress.log' ELSE 'drafter/metrics.json,drafter/report.md' END AS artifact_keys,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS passed
FROM (SELECT CAST(ts AS DATE) AS run_date, 'S' || CAST(user_id AS STRING) AS symbol, MIN(event_id) AS k
      FROM {events} GROUP BY CAST(ts AS DATE), user_id) r"""

VIEWS["v_files"] = """
SELECT make_date(2024, 1, CAST(1 + doc_id % 30 AS INT)) AS run_date, 'S' || CAST(doc_id % 150 AS STRING) AS symbol,
  doc_id, CASE WHEN doc_id % 2 = 0 THEN 'drafter' ELSE 'reviewer' END AS bucket,
  CASE doc_id % 7 WHEN 0 THEN 'report.md' WHEN 1 THEN 'metrics.json' WHEN 2 THEN 'research_notes.md'
    WHEN 3 THEN 'critique.md' WHEN 4 THEN '_progress.log' WHEN 5 THEN 'INDEX.md' ELSE 'prompt.md' END AS file_name, text
FROM {documents}"""

_CHAPTERS = [
    "一、核心摘要 (Executive Summary)", "二、IPO 关键信息速览 (IPO Snapshot)",
    "三、公司基本面深度剖析 (Fundamental Analysis)", "四、财务状况健康度评估 (Financial Health Assessment)",
    "五、股权结构与管理团队 (Ownership & Management)", "六、正向论据 (The Bull Case)", "七、反向论据 (The Bear Case)",
    "八、综合评估与策略结语 (Synthesis & Strategy)",
]
_TIER = "CASE {k} % 4 WHEN 0 THEN '强烈关注' WHEN 1 THEN '积极关注' WHEN 2 THEN '谨慎关注' ELSE '建议回避' END"


def _report() -> str:
    bodies = {
        0: _TIER.format(k="doc_id") + " || ' [1]'",
        1: "repeat('N/A, 暂无数据; ', CAST(doc_id % 7 AS INT))",
        2: "text",
        3: "CASE WHEN doc_id % 13 = 4 THEN 'Summary (English)' ELSE '' END",
        4: "CASE WHEN doc_id % 17 = 4 THEN '概览（中文）(en)' ELSE '' END",
        5: "CASE WHEN doc_id % 12 = 5 THEN 'A guaranteed, Risk-Free gain that must rise. guaranteed' ELSE '' END",
        6: "CASE WHEN doc_id % 8 = 3 THEN 'See [2] and [12].' ELSE 'See [2].' END",
        7: _TIER.format(k="(CASE WHEN doc_id % 10 = 7 THEN doc_id + 1 ELSE doc_id END)"),
    }
    parts = ["'# 《Company ' || CAST(doc_id AS STRING) || ' IPO 打新投资决策报告》'", NL, NL]
    for i, title in enumerate(_CHAPTERS):
        section = _join(_text("## " + title), NL, NL, f"({bodies[i]})", NL, NL)
        parts.append(section if i < 3 else f"CASE WHEN doc_id % 6 = 0 THEN '' ELSE {section} END")
    parts.append(f"CASE WHEN doc_id % 9 = 2 THEN repeat('## Extra notes' || {NL}, 6) ELSE '' END")
    parts += [_text("## 资料来源 (References)"), NL, NL]
    for i in range(1, 10):
        entry = _join(f"'[{i}] *Source {i}* SEC EDGAR '", "url", f"'-{i}'", "' Accessed 2026-05-18'", NL)
        parts.append(f"CASE WHEN doc_id % 10 >= {i} AND url IS NOT NULL THEN {entry} ELSE '' END")
    parts += [NL, _text("## 免责声明 (Disclaimer)"), NL, NL, "'Generated text, not investment advice.'", NL]
    return "CASE WHEN doc_id % 37 = 5 THEN NULL ELSE " + _join(*parts) + " END"


def _notes() -> str:
    parts = ["'# Research Notes D' || CAST(doc_id AS STRING)", NL, NL, "'## Web Research Log'", NL, NL]
    for i in range(1, 10):
        answer = (f"CASE WHEN (doc_id + {i}) % 5 = 0 THEN '- Searched: no usable result' "
                  f"WHEN (doc_id + {i}) % 11 = 0 THEN '- Key extract only' ELSE '- URL: ' || url || '-{i}' END")
        entry = _join(f"'### Query: \"query {i} of ' || CAST(doc_id AS STRING) || '\"'", NL, "'- Date: 2026-05-18'", NL,
                      f"({answer})", NL, NL)
        parts.append(f"CASE WHEN doc_id % 11 >= {i} AND url IS NOT NULL THEN {entry} ELSE '' END")
    return "CASE WHEN doc_id % 23 = 6 THEN NULL ELSE " + _join(*parts) + " END"


def _doc_metrics() -> str:
    rec = "CASE doc_id % 4 WHEN 0 THEN 'strong_buy' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'cautious' ELSE 'avoid' END"
    good = _join(
        "'{{\"symbol\": \"D' || CAST(doc_id AS STRING)", "'\", \"analysis_date\": \"2026-01-01\", \"market\": \"'",
        "CASE doc_id % 5 WHEN 0 THEN 'HK' WHEN 1 THEN 'Moon' ELSE 'US' END",
        "'\", \"company_display_name\": \"Company\", \"confidence\": ' || CASE WHEN doc_id % 16 = 9 THEN '1.4' "
        "ELSE '0.' || CAST(10 + doc_id % 90 AS STRING) END",
        "', \"predicted_price\": 42.50, \"signal\": \"' || CASE WHEN doc_id % 15 = 8 THEN 'sideways' ELSE 'bullish' END",
        "'\", \"risk_score\": 0.35, \"sector\": \"' || CASE WHEN doc_id % 14 = 3 THEN 'Unknown' ELSE source END",
        "'\", \"catalysts_count\": 4, \"risks_count\": 5, \"data_completeness\": 0.7, "
        "\"subscription_recommendation\": \"'", f"({rec})", "'\"}}'",
    )
    return f"""CASE doc_id % 21 WHEN 0 THEN NULL WHEN 1 THEN '{{{{bad' WHEN 2 THEN '[]' WHEN 3 THEN '{{{{}}}}'
      WHEN 4 THEN '{{{{"symbol": "D", "analysis_date": "2026-01-01", "subscription_recommendation": "moon_shot", "signal": ""}}}}'
      WHEN 5 THEN '{{{{"symbol": "D", "analysis_date": null, "market": "", "sector": "Unknown", "confidence": null, "signal": null, "risk_score": null, "subscription_recommendation": null}}}}'
      WHEN 6 THEN '{{{{"symbol": "D"}}}} tail' WHEN 7 THEN '{{{{"symbol": "D"}}}}] tail' WHEN 8 THEN chr(10) || '{{{{}}}}' ELSE {good} END""".replace("{{{{", "{{").replace("}}}}", "}}")


VIEWS["v_critique"] = """
SELECT doc_id, CASE WHEN doc_id % 19 = 3 THEN NULL ELSE """ + _join(
    "'# Reviewer Critique D' || CAST(doc_id AS STRING)", NL, NL, "'## Overall Verdict'", NL, NL,
    "'**' || CASE doc_id % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'NEEDS_REVISION' ELSE 'MAJOR_REWRITE' END || '**'", NL,
    NL, "'## Dimension Scores'", NL, NL, "'| Dimension | Score (0-5) | Comment |'", NL, "'|---|---|---|'", NL,
    *[_join(f"'| Dimension {i} | ' || CAST(x{i} AS STRING) || '/5 | note |'", NL) for i in range(1, 11)],
    NL, "'**Total: ' || CAST(" + " + ".join(f"x{i}" for i in range(1, 11))
    + " + CASE WHEN doc_id % 14 = 1 THEN 1 ELSE 0 END AS STRING) || ' / 50**'", NL, NL,
    "'## Required Fixes (must address before publication)'", NL, NL,
    *[f"CASE WHEN fixes >= {i} THEN '{i}. [chapter {i}] fix' || {NL} ELSE '' END" for i in range(1, 4)],
    NL, "'## Suggested Improvements (nice-to-have)'", NL, NL, "'1. optional'", NL, NL,
    "'## Recommended Next Action'", NL, NL,
    "'**' || CASE (doc_id + fixes) % 3 WHEN 0 THEN 'publish_as_is' WHEN 1 THEN 'revise' "
    "ELSE 'redraft_from_scratch' END || '**'", NL,
) + """ END AS critique
FROM (SELECT d.doc_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 0 ELSE d.doc_id % 4 END AS fixes, """ + ", ".join(
    f"CASE WHEN quality = 1 THEN 4 + (d.doc_id + {i}) % 2 ELSE (d.doc_id * {i}) % 6 END AS x{i}" for i in range(1, 11)
) + """ FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) s"""

VIEWS["v_reports"] = f"""
SELECT d.doc_id AS doc_key, 'D' || CAST(d.doc_id AS STRING) AS symbol,
  make_date(2026, CAST(1 + d.doc_id % 12 AS INT), CAST(1 + d.doc_id % 28 AS INT)) AS date,
  CASE WHEN d.doc_id % 2 = 0 THEN 'draft' ELSE 'final' END AS stage, d.report, d.research_notes, d.metrics_json, c.critique
FROM (SELECT doc_id, {_report()} AS report, {_notes()} AS research_notes, {_doc_metrics()} AS metrics_json
      FROM {{documents}} LEFT JOIN {{pages}} ON page_id = {_div('doc_id', '4')}) d
JOIN {{v_critique}} c ON d.doc_id = c.doc_id"""

VIEWS["v_url_status"] = "\nUNION ALL\n".join(
    f"SELECT url || '-{i}' AS url, CASE (page_id + {i}) % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN NULL "
    f"WHEN 3 THEN 503 ELSE 200 END AS status FROM {{pages}}" for i in range(1, 10)
)


def _progress() -> str:
    from tickerloom.fixed_values import PROGRESS_MILESTONES

    parts = []
    for j, name in enumerate(PROGRESS_MILESTONES):
        hour = f"lpad(CAST((doc_id + {j // 8}) % 24 AS STRING), 2, '0')"
        line = _join("'['", hour, f"':{(j * 7) % 60:02d}:'", "lpad(CAST(doc_id % 60 AS STRING), 2, '0')",
                     _text(f"] {name}"), NL)
        parts.append(f"CASE WHEN (doc_id + {j}) % 6 = 0 THEN '' ELSE {line} END")
        if j == 5:
            parts += ["text", NL]
    return _join(*parts)


VIEWS["v_progress"] = f"SELECT doc_id AS doc_key, {_progress()} AS log FROM {{documents}}"


def references(text: str) -> list[str]:
    """Tables and views a text refers to (doubled braces are literal)."""
    bare = text.replace("{{", "").replace("}}", "")
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", bare)))


class Views:
    """Spark side: DataFrames for driver tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, **given: DataFrame):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = dict(given)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = scale_partitions(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
            elif name in VIEWS:
                text = VIEWS[name]
                self._built[name] = self.spark.sql(text, **{r: getattr(self, r) for r in references(text)})
            else:
                raise AttributeError(name)
        return self._built[name]


@cache
def _closure(name: str) -> tuple[str, ...]:
    order: list[str] = []
    for r in references(VIEWS[name]):
        if r in VIEWS:
            order += [x for x in _closure(r) if x not in order]
    return (*order, name)


def oracle(body: str, **ctes: str) -> str:
    """DuckDB text: the views the body needs as CTEs, then extra CTEs, then the body.

    Braces in ``body`` and ``ctes`` follow the same rule as in the views.
    """
    texts = [*ctes.values(), body]
    order: list[str] = []
    for text in texts:
        for r in references(text):
            if r in VIEWS:
                order += [x for x in _closure(r) if x not in order]
    names = {n: n for n in [*TABLES, *VIEWS, *ctes]}
    parts = [f"{n} AS ({VIEWS[n].format_map(names)})" for n in order]
    parts += [f"{n} AS ({t.format_map(names)})" for n, t in ctes.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.format_map(names)
