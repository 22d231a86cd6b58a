"""Outcomes, publishing, sinks, ordered helpers and record assembly."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import plan_of, rows
from tickerloom import fixed_values as fv
from tickerloom.functions import ordered
from tickerloom.operators import enrich as en
from tickerloom.operators import outcomes as oc
from tickerloom.operators import partitions as pt
from tickerloom.operators import publish as p
from tickerloom.operators import sinks

DAY = dt.date
ATTEMPT = ("run_date DATE, symbol STRING, stage STRING, attempt INT, success BOOLEAN, gate_passed BOOLEAN, error STRING, "
           "duration_seconds DOUBLE")


def attempts(spark):
    d = DAY(2026, 1, 1)
    data = [
        (d, "A", "drafter", 1, True, False, None, 1.0), (d, "A", "drafter", 2, True, True, None, 1.0), (d, "A", "reviewer", 1, True, None, None, 1.0),
        (d, "A", "reviser", 1, True, True, None, 1.0), (d, "B", "drafter", 1, True, True, None, 1.0),
        (d, "B", "drafter", 2, True, True, None, 1.0), (d, "B", "reviser", 1, True, False, None, 1.0),
        (d, "B", "reviser", 2, False, None, "timeout", 1.0), (d, "C", "drafter", 1, False, None, "timeout", 1.0),
        (d, "C", "drafter", 3, True, True, None, 1.0)]
    return spark.createDataFrame(data, ATTEMPT)


def artifacts(spark):
    d = DAY(2026, 1, 1)
    return spark.createDataFrame(
        [(d, "A", 10, 5, 3, None, ["report.md"]), (d, "B", 10, 5, None, 4, ["report.md"]), (d, "C", None, 0, None, None, [])],
        "run_date DATE, symbol STRING, report_chars INT, metrics_fields INT, notes_chars INT, critique_chars INT, artifact_keys ARRAY<STRING>")


def test_final_outcomes_and_summary(spark):
    checks = spark.createDataFrame([(DAY(2026, 1, 1), "A", None)], "run_date DATE, symbol STRING, passed BOOLEAN")
    out = oc.final_outcomes(attempts(spark), artifacts(spark), checks)
    assert rows(out, "symbol", "success", "final_gate_passed", "error") == [
        ("A", True, True, None), ("B", True, False, None), ("C", False, False, "no_report")]
    failed = checks.withColumn("passed", F.lit(False))
    assert rows(oc.final_outcomes(attempts(spark), artifacts(spark), failed).where("symbol = 'A'"), "final_gate_passed") == [(False,)]
    assert rows(oc.run_summary(out), "runs", "success_count", "failure_count") == [(3, 2, 1)]
    record = {r["symbol"]: r for r in oc.run_records(attempts(spark), artifacts(spark)).collect()}
    assert [(o["stage"], o["attempt"]) for o in record["A"]["stage_outcomes"]] == [
        ("drafter", 1), ("drafter", 2), ("reviewer", 1), ("reviser", 1)]
    assert (record["A"]["research_notes_chars"], record["A"]["critique_chars"]) == (3, 0)
    files = spark.createDataFrame(
        [(DAY(2026, 1, 1), "C", "drafter", "report.md", "x" * 12), (DAY(2026, 1, 1), "C", "drafter", "other.md", "y"),
         (DAY(2026, 1, 1), "A", "drafter", "report.md", "z")],
        "run_date DATE, symbol STRING, bucket STRING, file_name STRING, text STRING")
    kept = rows(oc.failed_run_snapshots(out, files, 10), "artifact_key", "text")
    assert kept == [("drafter/report.md", "x" * 10 + "\n\n[TRUNCATED — original 12 chars]")]


def test_run_of_any_length_keeps_every_attempt(spark):
    n = 1_000_000
    hot = spark.range(n, numPartitions=8).select(
        F.lit(DAY(2026, 1, 1)).alias("run_date"), F.lit("HOT").alias("symbol"), F.when(F.col("id") % 4 == 0, "drafter").otherwise("reviser").alias("stage"),
        (n - F.col("id")).cast("int").alias("attempt"), F.lit(True).alias("success"), F.lit(False).alias("gate_passed"),
        F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("duration_seconds"))
    both = hot.unionByName(attempts(spark).select(*hot.columns))
    record = {r["symbol"]: r for r in oc.run_records(both, artifacts(spark), nested=3).collect()}
    assert [(o["stage"], o["attempt"]) for o in record["HOT"]["stage_outcomes"]] == [("drafter", 4), ("drafter", 8), ("drafter", 12)]
    assert record["HOT"]["more_outcomes"] == n - 3 and record["A"]["more_outcomes"] == 1 and record["C"]["more_outcomes"] == 0
    assert "WindowGroupLimit" in plan_of(oc.run_records(both, artifacts(spark)))
    ranked = oc.ranked_outcomes(both)
    places = ranked.where("symbol = 'HOT'").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count("*")).first()
    assert tuple(places) == (1, n, n, n)
    assert rows(ranked.where("symbol = 'HOT' AND (rank = 250000 OR rank = 250001)"), "stage", "attempt") == [("drafter", n), ("reviser", 1)]
    assert rows(ranked.where("symbol = 'B'"), "rank", "stage", "attempt") == [(1, "drafter", 1), (2, "drafter", 2), (3, "reviser", 1), (4, "reviser", 2)]


def test_attempt_violations(spark):
    out = rows(oc.attempt_violations(attempts(spark)), "symbol", "stage", "attempt", "broken")
    assert out == [("B", "drafter", 2, ["after_pass"]), ("C", "drafter", 3, ["after_failure", "beyond_max"])]


def test_ordered_helpers_equal_plain_windows_on_a_hot_key(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["HOT"] * 9 + ["a", "b"]), DAY(2026, 1, 1) + dt.timedelta(rnd.randrange(200)), rnd.choice("xyz"))
            for i in range(500)]
    df = spark.createDataFrame(data, "id INT, k STRING, day DATE, v STRING")
    w = Window.partitionBy("k").orderBy("day", "id")
    want = df.withColumn("prev", F.lag("v").over(w)).withColumn("next", F.lead("v").over(w)).withColumn(
        "n", F.sum(F.when(F.col("v") == "x", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    month = F.trunc("day", "month")
    got = ordered.previous_value(df, ["k"], ["day", "id"], "v", month, "prev")
    got = ordered.next_value(got, ["k"], ["day", "id"], "v", month, "next")
    got = ordered.running_total(got, ["k"], ["day", "id"], F.when(F.col("v") == "x", 1).otherwise(0), month, "n")
    assert rows(got, "id", "prev", "next", "n") == rows(want, "id", "prev", "next", "n")


def test_publishing(spark):
    reports = spark.createDataFrame(
        [("2026-01-02", "B"), ("2026-01-10", "A"), ("2026-01-01", "C"), ("2026-01-10", "Z/1")], "date STRING, symbol STRING")
    ranked = p.newest_reports(reports, 3)
    assert [(r["date"], r["symbol"]) for r in ranked.orderBy("weight").collect()] == [
        ("2026-01-10", "Z/1"), ("2026-01-10", "A"), ("2026-01-02", "B")]
    front = p.front_matter(ranked).where("weight = 0").first()
    assert (front["title"], front["slug"], front["url_path"], front["date"]) == (
        "Z/1 · IPO 研报", "2026-01-10-Z_1", "/reports/2026-01-10-Z_1/", "2026-01-10T00:00:00Z")
    assert rows(p.paginate(ranked, 2), "weight", "page", "page_count", "rows_on_page") == [(0, 1, 2, 2), (1, 1, 2, 2), (2, 2, 2, 1)]
    rated = spark.createDataFrame([("avoid", "Tech", "US"), ("avoid", None, "HK")], "rating STRING, sector STRING, market STRING")
    assert rows(p.facets(rated), "facet", "value", "reports") == [
        ("market", "HK", 1), ("market", "US", 1), ("rating", "avoid", 2), ("sector", "Tech", 1), ("sector", None, 1)]
    family = lambda name, data: spark.createDataFrame(
        [(s, d, name, r) for s, d, r in data], "symbol STRING, date DATE, family STRING, ref STRING")
    line = p.timeline(family("calendar", [("A", DAY(2026, 1, 1), "1")]), family("report", [("A", DAY(2026, 5, 1), "2"), ("A", DAY(2025, 1, 1), "3")]))
    assert rows(line, "position", "ref") == [(1, "3"), (2, "1"), (3, "2")]


def test_key_layout(spark):
    names = [n for n, _, _ in fv.KEY_FAMILIES]
    df = spark.createDataFrame([(n,) for n in names], "kind STRING")
    keys = df.select(p.storage_key(F.col("kind"), F.lit("2026-01-01"), F.lit("brk.b"), F.lit("/drafter/report.md")).alias("key"))
    assert rows(p.parse_storage_key(keys), "family", "date", "symbol") == sorted((n, "2026-01-01", "BRK.B") for n in names)
    assert ("debug/2026-01-01/BRK.B/drafter/report.md",) in rows(keys, "key")
    shared = df.limit(1).select(p.shared_bundle_key(F.lit("2026-01-01")).alias("key"))
    assert shared.first()["key"] == "raw_data/_shared/2026-01-01/fmp_prefetch_bundle.json"


def test_upsert_replaces_by_key_and_keeps_other_dates(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "date DATE, symbol STRING, body STRING, seq INT"
    first = spark.createDataFrame([(DAY(2026, 1, 1), "A", "old", 1), (DAY(2026, 1, 1), "B", "b", 1), (DAY(2026, 1, 2), "A", "other", 1)], schema)
    sinks.upsert(first, path, order="seq")
    second = spark.createDataFrame([(DAY(2026, 1, 1), "A", "new", 5), (DAY(2026, 1, 1), "A", "newer", 6), (DAY(2026, 1, 3), "C", "c", 1)], schema)
    want = [(DAY(2026, 1, 1), "A", "newer"), (DAY(2026, 1, 1), "B", "b"), (DAY(2026, 1, 2), "A", "other"), (DAY(2026, 1, 3), "C", "c")]
    for _ in range(2):
        sinks.upsert(second, path, order="seq")
        assert rows(spark.read.parquet(path), "date", "symbol", "body") == sorted(want, key=repr)


def test_upsert_refuses_repeated_keys_without_an_order(spark, tmp_path):
    twice = spark.createDataFrame([(DAY(2026, 1, 1), "A", "x"), (DAY(2026, 1, 1), "A", "y")], "date DATE, symbol STRING, body STRING")
    with pytest.raises(ValueError):
        sinks.upsert(twice, str(tmp_path / "table"))


def test_upsert_reads_touched_dates_only_and_finishes_what_was_broken_off(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "date DATE, symbol STRING, body STRING"
    sinks.upsert(spark.createDataFrame([(DAY(2026, 1, d), "A", "old") for d in (1, 2, 3)], schema), path)
    stored = spark.read.schema(schema).parquet(path)
    plan = plan_of(sinks.touched_dates(stored, [DAY(2026, 1, 2)]))
    assert "DataFilters: []" in plan and "PartitionFilters: [isnotnull(date" in plan or "Par...: [isnotnull(date" in plan
    assert sinks.touched_dates(stored, [DAY(2026, 1, 2)]).inputFiles() and "Filter " not in plan.replace("DataFilters", "")
    # A call that died after its rows were complete, before or while they replaced the table's.
    spark.createDataFrame([(DAY(2026, 1, 2), "A", "kept"), (DAY(2026, 1, 2), "B", "new")], schema).write.parquet(f"{path}__pending")
    sinks.upsert(spark.createDataFrame([(DAY(2026, 1, 2), "B", "newer")], schema), path)
    assert rows(spark.read.parquet(path), "date", "symbol", "body") == [
        (DAY(2026, 1, 1), "A", "old"), (DAY(2026, 1, 2), "A", "kept"), (DAY(2026, 1, 2), "B", "newer"), (DAY(2026, 1, 3), "A", "old")]
    assert not (tmp_path / "table__pending").exists()


def test_json_lines_keep_nulls_and_text(spark):
    df = spark.createDataFrame([(DAY(2026, 1, 1), None, "研报")], "day DATE, cik STRING, label STRING")
    assert sinks.json_lines(df).first()["json"] == '{"day":"2026-01-01","cik":null,"label":"研报"}'


def test_unknown_names_are_counted(spark):
    macro = spark.createDataFrame([("treasury_rates", None), ("economic_indicators", "GDP"), ("economic_indicators", "x"), ("other", None), (None, None)], "part STRING, name STRING")
    assert rows(en.unknown_macro(macro), "part", "name", "rows") == [("economic_indicators", "x", 1), ("other", None, 1), (None, None, 1)]
    fields = spark.createDataFrame([("stock_news",), ("typo",), ("typo",), (None,)], "field STRING")
    assert rows(en.unknown_fields(fields), "field", "rows") == [("typo", 2), (None, 1)]


def test_macro_limits(spark):
    macro = [("treasury_rates", None, i) for i in range(40)] + [("economic_calendar", None, i) for i in range(60)]
    macro += [("economic_indicators", n, i) for n in ("GDP", "other") for i in range(20)]
    df = spark.createDataFrame([(a, n, i, DAY(2026, 1, 1), float(i)) for a, n, i in macro],
                               "part STRING, name STRING, ord LONG, date DATE, value DOUBLE")
    bundle = en.macro_bundle(df, "2026-01-01").first()
    assert [x["ord"] for x in bundle["treasury_rates_tail"]] == list(range(10, 40))
    assert [x["ord"] for x in bundle["economic_calendar"]] == list(range(50))
    assert {k: len(x) for k, x in bundle["economic_indicators_trimmed"].items()} == {"GDP": 14}
    assert bundle["sector_pe_snapshot"] == [] and bundle["market_risk_premium"] is None
    nested = spark.range(1).select(
        F.sequence(F.lit(1), F.lit(40)).alias("treasury_rates"), F.sequence(F.lit(1), F.lit(60)).alias("economic_calendar"),
        F.create_map(F.lit("GDP"), F.sequence(F.lit(1), F.lit(20))).alias("economic_indicators"))
    out = en.compact_bundle(nested).first()
    assert out["treasury_rates"][0] == 11 and len(out["economic_calendar"]) == 50 and len(out["economic_indicators"]["GDP"]) == 14


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def record(spark, entry, landed=(), macro=None):
    profile = spark.createDataFrame(
        [("QUIX", "Quix", "320193", "Tech", None, "Chips", None, 10, None, "w", "d" * 100)],
        "symbol STRING, company_name STRING, cik STRING, sector STRING, sector_formatted STRING, industry STRING, industry_formatted STRING, "
        "employees LONG, ceo STRING, website STRING, description STRING")
    return en.build_records(
        spark.createDataFrame([entry], "ord LONG, symbol STRING, date DATE, expected_date STRING, company STRING, exchange STRING, "
                                       "cik STRING, price_range STRING, shares LONG, market_cap LONG"),
        profile=profile,
        row_datasets=[en.field_rows(
            spark.createDataFrame([("QUIX", "income_statement_annual", DAY(2025, 1, 1) + dt.timedelta(i), i) for i in range(20)],
                                  "symbol STRING, field STRING, date DATE, ord LONG"), en.newest_first(), ["date"])],
        eod=empty(spark, "symbol STRING, date DATE, close DOUBLE, adj_close DOUBLE, ord LONG"),
        series=empty(spark, "level STRING, name STRING, date DATE, ord LONG, value DOUBLE"),
        filings=empty(spark, "symbol STRING, date DATE, ord LONG, form STRING"),
        regulatory=empty(spark, "list STRING, ord LONG, symbol STRING, cik STRING, form STRING"),
        landed=spark.createDataFrame(list(landed), "event_id LONG, symbol STRING, dataset STRING, http_status INT, payload STRING"),
        fundraising=empty(spark, "cik STRING, rows ARRAY<VARIANT>"), macro=macro, run_date="2026-01-31")


def test_record_sections_catalog_and_payloads(spark):
    landed = [(1, "QUIX", "quote", 200, '{"price": 1}'), (2, "QUIX", "quote", 200, '{"price": 2}'), (3, "QUIX", "stock-peers", 200, '[{"s":"X"}]'),
              (4, "QUIX", "company-notes", 200, "[1]"), (5, "QUIX", "ratios-ttm", 503, None)]
    docs = record(spark, (1, "QUIX", DAY(2026, 1, 10), None, "Quix", "NYSE", None, None, 5, 7), landed).cache()
    row = docs.first()
    assert row["resolved_cik"] == "0000320193" and len(row["financials"]["income_statement_annual"]) == 8
    newest = json.loads(row["financials"]["income_statement_annual"][0].toJson())
    assert newest == {"date": "2025-01-20"}
    assert json.loads(row["market_context"]["quote"].toJson()) == {"price": 2}
    assert row["data_sources"] == ["fmp_ipo_calendar_row", "fmp_profile", "fmp_financial_statements", "fmp_quote", "fmp_stock_peers"]
    assert [(e["step"], e["error"]) for e in row["fetch_errors"]] == [
        ("company-notes", "non_object_entries"), ("ratios-ttm", "http_status: 503")]
    status = {r["partition"]: r["status"] for r in pt.availability(docs).collect()}
    assert len(status) == 13
    assert (status["ipo.json"], status["profile.json"], status["news.json"], status["macro.json"], status["fetch_errors.json"]) == (
        "full", "partial", "full", "empty", "full")
    payloads = {r["partition"]: json.loads(r["payload"]) for r in pt.split_record(docs).collect()}
    assert len(payloads) == 13 and list(payloads["peers.json"]) == ["_meta", "comparables"]
    assert payloads["macro.json"]["global_market_context"] is None
    assert payloads["peers.json"]["comparables"]["stock_peers"] == [{"s": "X"}]
    assert payloads["ipo.json"]["ipo_data"]["date"] == "2026-01-10" and payloads["ipo.json"]["ipo_data"]["priceRange"] is None
    metrics = {r["metric"]: r for r in pt.payload_metrics(docs).collect()}
    assert metrics["financials.income_statement_annual"]["value"] == 8
    assert metrics["ipo_data.priceRange"]["status"] == "missing"
    assert metrics["company_profile.description"]["detail"] == "d" * 77 + "..."
    text = pt.render_catalog(docs).first()["catalog"]
    assert "| `macro.json` |" in text and "- ipo_data.priceRange: missing" in text
    assert pt.error_samples(docs, samples=1).first()["samples"] == ["company-notes: non_object_entries"]
    docs.unpersist()


def test_a_symbol_without_any_data_keeps_its_record(spark):
    docs = record(spark, (1, "EMPTY", None, None, None, None, None, None, None, None))
    row = docs.first()
    assert row["data_sources"] == ["fmp_ipo_calendar_row"] and row["company_profile"] is None and row["fetch_errors"] == []
    assert row["market_context"]["window_from"] == DAY(2026, 1, 31) - dt.timedelta(420)
