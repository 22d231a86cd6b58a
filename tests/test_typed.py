"""Typed rows from landed payloads."""

import pytest

from tests.helpers import plan_of, rows
from tickerloom.sources.catalog import BY_NAME, DATASETS, FIELDS
from tickerloom.sources.typed import typed_rows

LANDED = "symbol string, dataset string, http_status int, payload string"


def landed(spark, *payloads, dataset="historical-price-eod/full", status=200):
    return spark.createDataFrame([(f"S{i}", dataset, status, p) for i, p in enumerate(payloads)], LANDED)


def test_every_dataset_has_fields():
    assert set(FIELDS) == set(BY_NAME) and len(DATASETS) == 43
    for fields in FIELDS.values():
        assert len({f.column for f in fields}) == len(fields)


def test_prices(spark):
    t = typed_rows(landed(
        spark, '[{"date": "2001-01-31", "close": 1.25, "adjClose": null, "volume": "7", "extra": {"a": 1}}, {"date": "soon", "close": "x"}]',
        '{"symbol": "A", "historical": [{"id": 5, "close": 2}]}', "{bad", "[1]", None, '{"Error Message": "limit"}', "[]"), "historical-price-eod/full")
    got = [(r.symbol, r.pos, r.ord, str(r.date), r.close, r.adj_close, r.volume, r.leftover) for r in t.rows.collect()]
    assert sorted(got, key=repr) == [
        ("S0", 0, None, "2001-01-31", 1.25, None, 7, {"extra": '{"a":1}'}), ("S0", 1, None, "None", None, None, None, {}), ("S1", 0, 5, "None", 2.0, None, None, {}),
    ]
    assert rows(t.cells, "symbol", "pos", "field", "wanted", "found") == [("S0", 1, "close", "double", '"x"'), ("S0", 1, "date", "date", '"soon"')]
    assert rows(t.payloads, "symbol", "error") == [("S2", "invalid_json"), ("S3", "non_object_entries"), ("S4", "unexpected_shape"), ("S5", "vendor_error: limit")]


def test_shapes(spark):
    profile = typed_rows(landed(spark, '[{"companyName": "A", "fullTimeEmployees": 3}, {"companyName": "B"}]', "[]", dataset="profile"), "profile")
    assert rows(profile.rows, "symbol", "company_name", "employees") == [("S0", "A", 3)] and rows(profile.payloads, "error") == [("no_rows",)]
    quote = typed_rows(landed(spark, '{"price": 2.5, "volume": 9000000000}', "42", dataset="quote"), "quote")
    assert rows(quote.rows, "symbol", "price", "volume") == [("S0", 2.5, 9000000000)]
    both = landed(spark, '[{"value": 1}]', dataset="news/stock").unionByName(landed(spark, '[{"value": 2}]', dataset="news/press-releases"))
    assert rows(typed_rows(both, "news/stock", "news/press-releases", keep=("dataset",)).rows, "dataset", "value") == [("news/press-releases", 2.0), ("news/stock", 1.0)]
    with pytest.raises(ValueError):
        typed_rows(both, "news/stock", "quote")
    assert typed_rows(landed(spark, '[{"value": 1}]', dataset="news/stock", status=503), "news/stock").rows.count() == 0


def test_hostile_names_and_one_pass(spark):
    t = typed_rows(landed(spark, '[{"value": 1, "it\'s": 2, "a.b": "x", "value2": null}]', dataset="news/stock"), "news/stock")
    assert t.rows.first().leftover == {"it's": "2", "a.b": "x", "value2": None}
    assert "Exchange" not in plan_of(t.rows) and plan_of(t.rows).count("try_parse_json") <= 1
