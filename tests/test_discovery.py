import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_of, rows
from tickerloom.operators import discovery as d
from tickerloom.sources import scans

DAY = dt.date


def calendar(spark):
    data = [(0, "QUIX", DAY(2026, 5, 9)), (1, None, DAY(2026, 5, 9)), (2, "BETA", DAY(2026, 5, 1)), (3, "", DAY(2026, 5, 2)),
            (4, "OLD", DAY(2026, 1, 1)), (5, "QUIX", DAY(2026, 5, 10))]
    return spark.createDataFrame(data, "ord LONG, symbol STRING, date DATE").withColumn("cik", F.lit("320193"))


def test_discover_override_cap(spark):
    found = d.discover(calendar(spark), "2026-05-10", 9)
    assert rows(found, "ord") == [(0,), (2,), (5,)]
    assert rows(d.override_entries(spark, ["aapl", "tsla"]), "symbol") == [("AAPL",), ("TSLA",)]
    assert rows(d.cap(found, 2), "ord") == [(0,), (2,)]
    assert d.cap(found, 0).count() == d.cap(found, None).count() == 3
    assert rows(d.stored_entries(found), "symbol", "ord") == [("BETA", 2), ("QUIX", max(r["ord"] for r in found.where("symbol = 'QUIX'").collect()))]
    summary = d.discovery_summary(found, "2026-05-10").first()
    assert (summary["count"], summary["symbols"]) == (3, 2)


def test_unprocessed_looks_at_any_date_and_only_at_canonical_keys(spark):
    keys = spark.createDataFrame([(k,) for k in (
        "reports/2020-01-01/quix_report.md", "reports/2026-01-01/notes.tmp", "wrong/2026-01-01/BETA_report.md",
        "metrics/2026-01-01/BETA_metrics.json")], "key STRING")
    entries = spark.createDataFrame([("QUIX",), ("BETA",), ("quix",)], "symbol STRING")
    # Only the stored side is upper-cased.
    assert rows(d.unprocessed(entries, keys), "symbol") == [("BETA",), ("quix",)]


def test_price_window(spark):
    data = [("a", DAY(2026, 1, 1), None), ("b", None, "2025-06-01T00:00"), ("c", None, "soon"), ("d", DAY(2029, 1, 1), None)]
    df = spark.createDataFrame(data, "symbol STRING, date DATE, expectedDate STRING")
    out = {r["symbol"]: r["window_from"] for r in d.price_window(df, "2026-05-10").collect()}
    today = DAY(2026, 5, 10)
    assert out == {"a": DAY(2026, 1, 1) - dt.timedelta(800), "b": DAY(2025, 6, 1) - dt.timedelta(800),
                   "c": today - dt.timedelta(420), "d": today - dt.timedelta(120)}


def regulatory(spark, extra=()):
    data = [("disclosures", 1, "ABC", None, None), ("disclosures", 2, None, "abc ", None), ("disclosures", 3, "ZZZ", None, None),
            ("disclosures", 4, "ZZZ", None, "320193"), ("prospectuses", 5, "ABC", None, "0000320193"), ("disclosures", 6, "", None, None),
            *extra]
    return spark.createDataFrame(data, "list STRING, ord LONG, symbol STRING, ticker STRING, cik STRING")


def test_regulatory_match(spark):
    entries = spark.createDataFrame([("ABC", "0000320193"), ("NIL", None)], "symbol STRING, resolved_cik STRING")
    out = d.match_regulatory(entries, regulatory(spark))
    assert rows(out, "symbol", "list", "ord") == [("ABC", "disclosures", 1), ("ABC", "disclosures", 2), ("ABC", "disclosures", 4),
                                                  ("ABC", "prospectuses", 5)]
    first = d.match_regulatory(entries, regulatory(spark), max_rows=2)
    assert rows(first.where("list = 'disclosures'"), "ord") == [(1,), (2,)]
    assert "NestedLoop" not in plan_of(out) and "CartesianProduct" not in plan_of(out)


def test_regulatory_match_equals_brute_force(spark):
    import random

    rnd = random.Random(5)
    # One symbol holds most rows.
    extra = [("disclosures", 100 + i, rnd.choice(["HOT"] * 6 + ["ABC", "S2", None]), None,
              rnd.choice(["320193", "77", None, "None"])) for i in range(600)]
    entries = [("ABC", "0000320193"), ("HOT", "0000000077"), ("S2", None)]
    table = regulatory(spark, extra)
    got = rows(d.match_regulatory(spark.createDataFrame(entries, "symbol STRING, resolved_cik STRING"), table, 50),
               "symbol", "list", "ord")
    pad = lambda c: c.zfill(10) if c and c.isdigit() else (None if c in (None, "", "None") else c)
    want = []
    for symbol, cik in entries:
        for name in ("disclosures", "prospectuses"):
            hits = [r["ord"] for r in sorted(table.collect(), key=lambda r: r["ord"]) if r["list"] == name and (
                (r["symbol"] or r["ticker"] or "").strip().upper() == symbol or (cik and pad(r["cik"]) == cik))]
            want += [(symbol, name, o) for o in hits[:50]]
    assert got == sorted(want, key=repr)


def eod(spark):
    start = DAY(2026, 1, 1)
    data = [("A", start + dt.timedelta(i), float(i), None, i) for i in range(100)]
    data += [("A", None, 7.0, None, 500), ("SPY", DAY(2026, 3, 1), 1.0, None, 1), ("SPY", None, 2.0, None, 2)]
    return spark.createDataFrame(data, "symbol STRING, date DATE, close DOUBLE, adj_close DOUBLE, ord LONG")


def test_window_prices_keep_the_newest_and_put_undated_last(spark):
    entries = spark.createDataFrame([("A", DAY(2026, 3, 20)), ("B", DAY(2026, 1, 1))], "symbol STRING, window_from DATE")
    out = d.window_prices(entries, eod(spark), "2026-04-05", max_rows=72)
    got = [(r["date"], r["rank"]) for r in out.orderBy("rank").collect()]
    assert len(got) == 18 and got[0] == (DAY(2026, 4, 5), 1) and got[-1] == (None, 18)
    assert d.window_prices(entries, eod(spark), "2026-04-05", max_rows=5).count() == 5
    bench = d.window_benchmark(entries, eod(spark), "2026-04-05")
    sizes = {r["symbol"]: len(r["benchmark_eod_recent"]) for r in bench.collect()}
    assert sizes == {"A": 1, "B": 2}


def test_sector_history_keeps_the_tail(spark):
    series = spark.createDataFrame(
        [("sector", "Tech", DAY(2026, 1, 1) + dt.timedelta(i), i, float(i)) for i in range(60)],
        "level STRING, name STRING, date DATE, ord LONG, value DOUBLE")
    profile = spark.createDataFrame([("A", " Tech ", None, "", "Chips")],
                                    "symbol STRING, sector STRING, sector_formatted STRING, industry STRING, industry_formatted STRING")
    entries = spark.createDataFrame([("A",), ("B",)], "symbol STRING")
    out = {r["symbol"]: r for r in d.sector_history(entries, profile, series).collect()}
    assert [p["ord"] for p in out["A"]["sector_history"]] == list(range(20, 60))
    assert out["A"]["industry"] == "Chips" and out["A"]["industry_history"] is None and out["B"]["sector"] is None


def test_scans(spark):
    with pytest.raises(ValueError):
        scans.period_table(eod(spark).withColumn("period", F.lit("annual")), "weekly", 3)
    with pytest.raises(ValueError):
        scans.named_series(eod(spark), "sector", "  ")
    assert scans.batch_lookup(eod(spark), ["", " "]).count() == 0
    assert scans.batch_lookup(eod(spark), [" spy "]).count() == 2
    wanted = spark.createDataFrame([(" a ",), ("",), (None,)], "symbol STRING")
    top = scans.for_symbols(eod(spark), wanted, order=[F.col("date").desc_nulls_last()], limit=3)
    assert rows(top, "ord") == [(97,), (98,), (99,)]
    assert "WindowGroupLimit" in plan_of(top)
    page = scans.window_page(eod(spark), "2026-01-01", "2026-02-01", page=1, limit=20)
    assert [r["rank"] for r in page.where("symbol = 'A'").orderBy("rank").collect()] == list(range(21, 33))
