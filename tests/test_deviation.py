import datetime as dt
import random

from pyspark.sql import functions as F

from tests.helpers import plan_of, rows
from tickerloom.operators import bias as b
from tickerloom.operators import deviation as dev

DAY = dt.date
EOD = "symbol STRING, date DATE, close DOUBLE, adj_close DOUBLE, ord LONG"
FORECAST = "symbol STRING, metrics_date DATE, predicted_price DOUBLE, confidence DOUBLE"


def evaluate(spark, prices, forecasts, **options):
    out = dev.evaluate(spark.createDataFrame(forecasts, FORECAST), spark.createDataFrame(prices, EOD), **options)
    return {r["symbol"]: r for r in out.collect()}


def test_first_price_on_or_after_the_target(spark):
    prices = [("A", DAY(2026, 2, 13), 1.0, None, 1), ("A", DAY(2026, 2, 17), 95.0, None, 2), ("A", DAY(2026, 2, 18), 96.0, None, 3),
              ("B", DAY(2026, 2, 20), 5.0, None, 1), ("C", None, 8.0, None, 1), ("C", None, 9.0, None, 2),
              ("D", DAY(2026, 2, 14), 0.0, 48.0, 1), ("E", DAY(2026, 2, 14), None, None, 1), ("F", DAY(2026, 2, 14), None, 0.0, 1),
              ("G", DAY(2026, 2, 19), 20.0, None, 2), ("G", DAY(2026, 2, 19), 30.0, None, 1)]
    asked = [(s, DAY(2026, 1, 15), None if s == "H" else 100.0, 0.5) for s in "ABCDEFGH"]
    out = evaluate(spark, prices, asked)
    assert out["A"]["actual_price"] == 95.0 and out["A"]["price_date"] == DAY(2026, 2, 17)
    assert abs(out["A"]["deviation"] - 5 / 95) < 1e-12 and out["A"]["within_threshold"] is True
    assert out["B"]["error"] == "no_price_rows" and out["B"]["within_threshold"] is None
    assert out["C"]["actual_price"] == 9.0
    assert out["D"]["actual_price"] == 48.0
    assert out["E"]["error"] == "no_close_price"
    assert out["F"]["deviation"] == 0.0 and out["F"]["within_threshold"] is True
    assert out["G"]["actual_price"] == 30.0
    assert out["H"]["error"] == "no_predicted_price"


def test_threshold_is_inclusive_and_the_offset_a_parameter(spark):
    prices = [("A", DAY(2026, 1, 20), 100.0, None, 1)]
    out = evaluate(spark, prices, [("A", DAY(2026, 1, 15), 125.0, None)], offset_days=5, threshold=0.25)
    assert out["A"]["within_threshold"] is True and out["A"]["deviation_pct"] == 25.0


def test_stored_documents(spark):
    asked = spark.createDataFrame([(s, DAY(2026, 1, 15)) for s in "ABCDE"], "symbol STRING, metrics_date DATE")
    stored = spark.createDataFrame([
        ("A", DAY(2026, 1, 15), '{"predicted_price": 10.5, "confidence": 0.5}'), ("B", DAY(2026, 1, 15), '{"predicted_price": 1} x'),
        ("C", DAY(2026, 1, 15), '{"predicted_price": null}'), ("D", DAY(2026, 1, 15), "[]")],
        "symbol STRING, date DATE, metrics_json STRING")
    out = {r["symbol"]: (r["metrics_error"], r["predicted_price"]) for r in dev.read_forecasts(asked, stored).collect()}
    assert out == {"A": (None, 10.5), "B": ("invalid_metrics", None), "C": (None, None), "D": ("invalid_metrics", None),
                   "E": ("missing_metrics", None)}


def test_as_of_equals_brute_force_with_a_hot_symbol(spark):
    rnd = random.Random(3)
    day = lambda: DAY(2026, 1, 1) + dt.timedelta(rnd.randrange(120))
    symbols = ["HOT"] * 5 + ["X", "Y", "Z"]
    prices = [(rnd.choice(symbols), day(), float(rnd.randrange(1, 50)), None, i) for i in range(400)]
    asked = sorted({(rnd.choice(symbols), day()) for _ in range(200)})
    frame = spark.createDataFrame([(s, d) for s, d in asked], "symbol STRING, target_date DATE")
    got = dev.as_of_price(frame, spark.createDataFrame(prices, EOD))
    assert "NestedLoop" not in plan_of(got) and "Window" not in plan_of(got)
    got = {(r["symbol"], r["target_date"]): (r["price_date"], r["close"]) for r in got.collect()}
    for s, target in asked:
        inside = sorted((p[1], p[4], p[2]) for p in prices if p[0] == s and target <= p[1] <= target + dt.timedelta(5))
        assert got[s, target] == ((inside[0][0], inside[0][2]) if inside else (None, None))


def test_history_is_appended_never_deduplicated(spark, tmp_path):
    path = str(tmp_path / "history")
    records = spark.createDataFrame([("A", 0.1)], "symbol STRING, deviation DOUBLE")
    dev.append_history(records, path, "2026-01-01")
    dev.append_history(records, path, "2026-01-01")
    assert spark.read.parquet(path).count() == 2


HISTORY = "symbol STRING, date DATE, within_threshold BOOLEAN, deviation DOUBLE"


def history(spark, n, misses, sign=1.0, symbol="A"):
    data = [(symbol, DAY(2026, 1, 1) + dt.timedelta(i), i >= misses, sign * (0.3 if i < misses else 0.05)) for i in range(n)]
    return spark.createDataFrame(data, HISTORY)


def decision(df, **options):
    return b.decide(b.analyze(df, **options)).first()


def test_decisions(spark):
    assert decision(history(spark, 0, 0))["reason"] == "no_history"
    few = decision(history(spark, 3, 3), min_samples=10)
    assert (few["action"], few["reason"], few["failure_count"]) == ("skip", "insufficient_samples", 0)
    fine = decision(history(spark, 10, 2))
    assert (fine["action"], fine["reason"], fine["failure_rate"]) == ("skip", "within_threshold", 0.2)
    half = decision(history(spark, 10, 5))
    assert half["needs_correction"] is False
    over, under = decision(history(spark, 10, 8)), decision(history(spark, 10, 8, -1.0))
    assert (over["action"], over["bias_direction"], under["bias_direction"]) == ("corrected", "overestimate", "underestimate")
    assert abs(over["avg_deviation"] - 0.3) < 1e-12 and abs(under["avg_signed_deviation"] + 0.3) < 1e-12
    assert decision(history(spark, 10, 0))["bias_direction"] == "underestimate"


def test_correction_text_and_versions(spark):
    events = b.correction_events(b.decide(b.analyze(history(spark, 16, 13))), F.lit("2026-02-01T00:00:00"))
    event = events.first()
    # 81.25 is a tie and goes to the even digit.
    assert event["recommendation"] == (
        "Adjust for overestimate bias. Average deviation: 30.00%. Failure rate: 81.2% (13/16 samples).")
    versions = spark.createDataFrame(
        [("p", dt.datetime(2026, 1, 1), "old"), ("p", dt.datetime(2026, 1, 20), "new"), ("q", dt.datetime(2026, 1, 5), "x")],
        "prompt STRING, version_ts TIMESTAMP, content STRING")
    added = b.apply_corrections(versions, events)
    texts = {r["prompt"]: r["content"] for r in added.collect()}
    assert texts["p"].startswith("new\n\n---\n") and "81% of recent predictions" in texts["p"]
    ranges = rows(b.version_ranges(versions.unionByName(added)), "prompt", "valid_from", "valid_to", "is_current")
    assert [r[3] for r in ranges if r[0] == "p"] == [False, False, True]
    assert ranges[0][2] == ranges[1][1]


def test_streaks_and_meta_review(spark):
    pattern = "FFFTFFTFFFF"
    data = [("A", DAY(2025, 12, 25) + dt.timedelta(i * 20), c == "T", 0.3) for i, c in enumerate(pattern)]
    out = rows(b.miss_streaks(spark.createDataFrame(data, HISTORY)), "streak", "first_date")
    assert [r[0] for r in out] == [3, 4]
    review = b.meta_review(history(spark, 10, 1)).first()
    assert (review["action"], review["pass_rate"], review["direction"], review["consistency"]) == ("no_action", 0.9, "overestimate", 1.0)
    assert b.meta_review(history(spark, 10, 8)).first()["action"] == "correct"
    assert b.meta_review(history(spark, 4, 4)).first()["action"] == "monitor"


def test_bias_by_factor(spark):
    profile = spark.createDataFrame([("A", "Tech"), ("B", "Energy")], "symbol STRING, sector STRING")
    both = history(spark, 4, 1).unionByName(history(spark, 6, 6, -1.0, "B"))
    out = rows(b.bias_by_factor(both, profile), "sector", "is_total", "samples", "misses")
    assert out == [("Energy", 0, 6, 6), ("Tech", 0, 4, 1), (None, 1, 10, 7)]


def test_history_is_worked_out_once_for_two_appends(spark, monkeypatch):
    from tests.helpers import plan_of
    from tickerloom.operators import deviation
    from tickerloom.plans import load_all
    from tickerloom.plans.registry import QUERIES

    load_all()
    given, append = [], deviation.append_history
    monkeypatch.setattr(deviation, "append_history", lambda records, *a: (given.append(plan_of(records)), append(records, *a)))
    QUERIES["e06_history_append"](spark, "/root/testdata/sf0.001")
    assert len(given) == 2 and not any("Join" in p or "Exchange" in p for p in given)
