import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import one, text
from tickerloom.functions import collections as co
from tickerloom.functions import scalars as sc
from tickerloom.sources.landed import fetch_class


@pytest.mark.parametrize("given, wanted", [
    ("320193", "0000320193"), ("0001234567", "0001234567"), ("", None), (None, None), (" None ", None), ("NULL", None),
    ("12345678901", "12345678901"), (" CIK7 ", "CIK7"), ("\t42\n", "0000000042")])
def test_cik(spark, given, wanted):
    assert one(spark, sc.normalize_cik(text(spark, given))) == wanted


@pytest.mark.parametrize("given, wanted", [(" aapl\n", "AAPL"), ("　brk.b ", "BRK.B"), ("  ", None), (None, None)])
def test_symbol(spark, given, wanted):
    assert one(spark, sc.normalize_symbol(text(spark, given))) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("2026-01-15", dt.date(2026, 1, 15)), (" 2026-01-15T10:00:00Z ", dt.date(2026, 1, 15)), ("20260115", dt.date(2026, 1, 15)),
    ("2026-13-01", None), ("TBD", None), ("", None), (None, None), ("20260115xx", None)])
def test_tolerant_date(spark, given, wanted):
    assert one(spark, sc.parse_iso_date(text(spark, given))) == wanted


def test_label_is_chosen_before_trimming(spark):
    label = lambda a, b: one(spark, sc.clean_label(text(spark, a), text(spark, b)))
    assert label("", "Energy ") == "Energy"
    assert label(None, "Energy") == "Energy"
    assert label("  ", "Energy") is None
    assert one(spark, sc.first_nonblank(text(spark, "  "), text(spark, " x "))) == "x"


def test_shorten_and_truncate(spark):
    assert one(spark, sc.shorten(F.lit("a" * 80))) == "a" * 80
    assert one(spark, sc.shorten(F.lit("a" * 81))) == "a" * 77 + "..."
    assert one(spark, sc.truncate_with_note(F.lit("é" * 12), 10)) == "é" * 10 + "\n\n[TRUNCATED — original 12 chars]"


def test_slug(spark):
    assert one(spark, sc.report_basename(F.lit("2026-01-01"), F.lit("BRK/B 中"))) == "2026-01-01-BRK_B__"


def test_head_and_tail(spark):
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, co.tail(three, 2)) == [2, 3]
    assert one(spark, co.tail(three, 5)) == [1, 2, 3]
    assert one(spark, co.tail(three, 0)) == []
    assert one(spark, co.head(three, 2)) == [1, 2]


@pytest.mark.parametrize("given, valid", [
    ('{"a":1}', True), ("[]", True), ("42", True), ('{"a":1} x', False), ('{"a":1}}', False), ("{bad", False), ("", False),
    ("{},{}", False), (None, False)])
def test_strict_json(spark, given, valid):
    assert one(spark, co.strict_json(text(spark, given))) is valid


@pytest.mark.parametrize("given, populated, truthy", [
    ("null", False, False), ("[]", False, False), ("{}", False, False), ('{"a":null}', True, True), ("0", True, False),
    ('""', True, False), ("[0]", True, True)])
def test_populated_and_truthy(spark, given, populated, truthy):
    df = spark.range(1).select(F.try_parse_json(F.lit(given)).alias("v"))
    tests = (co.variant_populated_sql("v"), co.variant_truthy_sql("v"))
    assert df.selectExpr(*[f"{t} AS t{i}" for i, t in enumerate(tests)]).first() == (populated, truthy)


@pytest.mark.parametrize("status, wanted", [(200, "ok"), (404, "fatal"), (401, "fatal"), (429, "retryable"), (503, "retryable"),
                                            (None, "retryable")])
def test_fetch_class(spark, status, wanted):
    assert one(spark, fetch_class(F.lit(status).cast("int"))) == wanted
