"""One JSON rule for landed payloads, forecasts, gate and contracts."""

import datetime as dt

import pytest

from tests.helpers import one, rows, text
from tests.test_gate import docs
from tickerloom import fixed_values as fv
from tickerloom.functions import text as tx
from tickerloom.functions.collections import looks_like_object, strict_json
from tickerloom.operators import contracts, deviation, gate
from tickerloom.operators import enrich as en
from tickerloom.sources import landed


@pytest.mark.parametrize("value, valid", [
    ("{}", True), ("\n[1, 2]\t", True), ('"a"', True), ("42", True), ("null", True), ("[]", True), (None, False), ("", False), (" ", False), ("{} x", False),
    ('{"a":1}] junk', False), ("[1] [2]", False), ("1, 2", False), ("{bad", False), ("]", False), ("{}]", False), ("{}],[{}", False), ('{"a":1,"a":2}', True),
])
def test_strict_json(spark, value, valid):
    assert one(spark, strict_json(text(spark, value))) is valid


def test_looks_like_object(spark):
    assert [one(spark, looks_like_object(text(spark, x))) for x in ("{}", "\n\t {", "[{", None, "\u00a0{")] == [True, True, False, False, False]


def test_last_repeated_key_wins(spark):
    frame = spark.createDataFrame([("d", "S", 200, '{"a":1,"a":2}')], "dataset STRING, symbol STRING, http_status INT, payload STRING")
    got = landed.list_rows(frame).selectExpr("to_json(body) AS body", "row_error", "size(rows) AS n").first()
    assert tuple(got) == ('{"a":2}', None, 1)
    day = dt.date(2026, 1, 1)
    requests = spark.createDataFrame([("S", day)], "symbol STRING, metrics_date DATE")
    metrics = spark.createDataFrame([("S", day, 1, '{"predicted_price": 1, "predicted_price": 7.5}')], "symbol STRING, date DATE, ord LONG, metrics_json STRING")
    assert rows(deviation.read_forecasts(requests, metrics), "metrics_error", "predicted_price") == [(None, 7.5)]


def test_calendar_and_profile_shapes(spark):
    texts = ['[{"a":1},{"a":2}]', "[]", '{"a":3}', "42", "null", None, "[5]"]
    frame = spark.createDataFrame(
        [(f"S{i}", d, 200, t) for i, t in enumerate(texts) for d in ("ipos-calendar", "profile")], "symbol STRING, dataset STRING, http_status INT, payload STRING")
    found = {(r["dataset"], r["symbol"]): (r["error"], r["n"]) for r in en.normalized_payloads(frame).selectExpr("*", "size(rows) AS n").collect()}
    bad = ("unexpected_type", 0)
    assert [found["ipos-calendar", f"S{i}"] for i in range(7)] == [(None, 2), (None, 0), bad, bad, bad, bad, (None, 1)]
    assert [found["profile", f"S{i}"] for i in range(7)] == [(None, 1), ("no_rows", 0), (None, 1), bad, bad, bad, (None, 1)]
    for rule, dataset in ((landed.strict_rows, "ipos-calendar"), (landed.singleton_row, "profile")):
        single = {r["symbol"]: (r["row_error"], r["n"]) for r in rule(frame.where(f"dataset = '{dataset}'")).selectExpr("*", "size(rows) AS n").collect()}
        assert all(single[s] == v for (d, s), v in found.items() if d == dataset)


def test_leading_blanks_do_not_hide_a_document(spark):
    both = docs(spark, a={"metrics_json": "\n{}"}, b={"metrics_json": "{}"})
    found = {r["doc_key"]: r["missing_keys"] for r in gate.measure(both).collect()}
    assert found["a"] == found["b"] and len(found["a"]) == len(fv.REQUIRED_METRIC_KEYS)
    assert len(rows(contracts.metric_rules(both), "doc_key")) == 2


def test_phrase_count_follows_the_list(spark, monkeypatch):
    value = text(spark, "N/A, unknown; 未提供 and Missing here")
    assert one(spark, tx.missing_phrase_count(value)) == 3
    monkeypatch.setattr(fv, "MISSING_PHRASE", fv.MISSING_PHRASE + "|Missing")
    assert one(spark, tx.missing_phrase_count(value)) == 4
