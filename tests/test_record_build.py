"""What the record build moves, reads and holds: lines by order, one pass over regulatory rows, cut rows, payloads of entries only."""

import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_of, rows
from tickerloom import session
from tickerloom.operators import discovery as d
from tickerloom.plans import record_queries as rq
from tickerloom.plans import silver
from tickerloom.plans.views import Views

FOLDER = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver data not present")


@with_data
def test_rows_grouped_by_order_move_no_line(spark):
    v = Views(spark, FOLDER)
    tables = silver.SilverViews(v).prepare()
    assert "Exchange" not in plan_of(tables.v_lines.groupBy("orderkey").agg(F.sum("cents")))
    assert "Exchange" not in plan_of(tables.v_order_lines.groupBy("ord").agg(F.sum("cents")))
    assert "Exchange" not in plan_of(tables.v_regulatory)
    for name in ("v_daily", "v_financials", "v_order_lines", "v_regulatory"):
        assert rows(getattr(tables, name), "*") == rows(getattr(v, name), "*")


def test_regulatory_rows_are_read_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    data = [("disclosures", i, "S-1", f" a{i % 3}" if i % 2 else None, str(i % 4) if i % 5 else None) for i in range(60)]
    spark.createDataFrame(data, "list string, ord long, form string, symbol string, cik string").write.parquet(path)
    entries = spark.createDataFrame([("A0", "0000000001"), ("a1", None), ("A2", "0000000002")], "symbol string, resolved_cik string")
    out = d.match_regulatory(entries, spark.read.parquet(path), max_rows=7)
    assert plan_of(out).count("FileScan") == 1
    want = []
    for symbol, cik in (("A0", "0000000001"), ("a1", None), ("A2", "0000000002")):
        hits = [r for r in data if (r[3] or "").strip().upper() == symbol.upper() or (r[4] and cik and r[4].zfill(10) == cik)]
        want += [(symbol, cik, r[1], r[3] and r[3].strip().upper(), r[4] and r[4].zfill(10), n) for n, r in enumerate(sorted(hits, key=lambda r: r[1])[:7], 1)]
    assert rows(out, "symbol", "resolved_cik", "ord", "row_symbol", "row_cik", "rank") == sorted(want, key=repr)


@with_data
def test_statements_are_cut_to_their_own_limits(spark):
    plan = plan_of(rq.statement_rows(Views(spark, FOLDER)))
    assert "row_number(), 8, Partial" in plan and "row_number(), 72" not in plan
    assert "row_number(), 35, Partial" in plan_of(rq.news_rows(Views(spark, FOLDER)))


@with_data
def test_only_payloads_of_entries_are_folded(spark):
    v, seen = Views(spark, FOLDER), {}

    def store(tables):
        seen.update({name: table() for name, table in tables.items()})
        return seen

    rq.assembled(v, store=store)
    wanted, landed = ({r.symbol for r in t.select("symbol").collect()} for t in (seen["company"], v.v_landed))
    assert {r.symbol for r in seen["payloads"].select("symbol").collect()} == wanted & landed < landed


@with_data
def test_records_are_built_in_small_tasks(spark, monkeypatch):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen = [spark.conf.get(n) for n in names], []

    def assembled(v, **store):
        seen.append([spark.conf.get(n) for n in names])
        return spark.range(3)

    monkeypatch.setattr(rq, "assembled", assembled)
    monkeypatch.setattr(silver, "_WRITTEN", {})
    monkeypatch.setattr(silver.SilverViews, "prepare", lambda self: self)
    assert rq.records_of(Views(spark, FOLDER)).count() == 3
    assert seen == [[str(session._TASK_BYTES)] * 2] and [spark.conf.get(n) for n in names] == before
    with pytest.raises(ValueError), session.small_tasks(spark):
        raise ValueError
    assert [spark.conf.get(n) for n in names] == before
