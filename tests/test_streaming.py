import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_gate import docs
from tickerloom.session import scratch_dir
from tickerloom.streaming import jobs

EVENTS = "symbol STRING, ts TIMESTAMP, event_id LONG, status STRING"


def events(spark):
    start = dt.datetime(2026, 1, 1)
    pattern = [("A", "new"), ("A", "new"), ("B", "new"), ("A", "priced"), ("B", "filed"), ("A", "new"), ("B", "filed"), ("C", "new")]
    return spark.createDataFrame([(s, start + dt.timedelta(hours=9 * i), i, x) for i, (s, x) in enumerate(pattern)], EVENTS)


def stream(spark, df, path, files):
    """Land the rows as one file per batch, oldest first."""
    n = df.count()
    for i in range(files):
        part = df.where(F.floor(F.col("event_id") * files / n) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_status_stream_equals_batch_over_several_batches(spark, tmp_path):
    want = rows(jobs.status_changes(events(spark)), "symbol", "event_id", "previous", "status")
    assert [(r[0], r[1]) for r in want] == [("A", 0), ("A", 3), ("A", 5), ("B", 2), ("B", 4), ("C", 7)]
    source = stream(spark, events(spark), str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    jobs.status_change_stream(source, out, str(tmp_path / "last"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").iterdir())) == 4
    assert rows(spark.read.parquet(out), "symbol", "event_id", "previous", "status") == want


def test_state_tables_are_the_digits_of_the_batch_count():
    assert jobs.state_tables(0, 3) == []
    assert jobs.state_tables(5, 3) == [(0, 3), (3, 4), (4, 5)]
    assert jobs.state_tables(9, 3) == [(0, 9)]
    for done in range(200):
        tables = jobs.state_tables(done, 3)
        assert [a for a, _ in tables] + [done] == [0] + [b for _, b in tables]
        assert len(set(jobs.state_tables(done + 1, 3)) - set(tables)) == 1


def test_state_holds_changed_symbols_only_and_merged_tables_go(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    batches = [[(s, start + dt.timedelta(days=k), 100 * k + i, x) for i, (s, x) in enumerate(b)] for k, b in enumerate([
        [("A", "new"), ("B", "new"), ("C", "new")],
        [("A", "new"), ("B", "priced")],
        [("C", "filed"), ("C", "new"), ("A", "priced")],
        [],
        [("A", "priced"), ("B", "new")],
        [("D", "new")],
        [("B", "priced"), ("C", "new"), ("D", "new")],
        [("A", "new")],
    ])]
    out, state = str(tmp_path / "out"), str(tmp_path / "last")
    frame = lambda b: spark.createDataFrame(b, EVENTS)
    sizes = []
    for epoch, batch in enumerate(batches):
        # A micro-batch that runs again must give what it gave.
        for _ in range(2):
            jobs.store_status_changes(frame(batch), epoch, out, state, merge_every=3)
            added = [t for t in jobs.state_tables(epoch + 1, 3) if t not in jobs.state_tables(epoch, 3)]
            sizes.append(spark.read.parquet(jobs._state_path(state, added[0])).count())
    # Batches 3 and 6 (from 1) merge the tables of three batches.
    assert sizes[::2] == sizes[1::2] == [3, 1, 3, 0, 1, 2, 1, 1]
    want = rows(jobs.status_changes(frame([r for b in batches for r in b])), "symbol", "event_id", "previous", "status")
    assert rows(spark.read.parquet(out), "symbol", "event_id", "previous", "status") == want
    assert sorted(p.name for p in (tmp_path / "last").iterdir()) == ["batches=0-3", "batches=3-6", "batches=6-7", "batches=7-8"]
    last = rows(spark.read.parquet(*map(str, (tmp_path / "last").iterdir())).groupBy("symbol").agg(F.max_by("status", "epoch").alias("s")), "symbol", "s")
    assert last == [("A", "new"), ("B", "priced"), ("C", "new"), ("D", "new")]


def test_discovery_stream(spark, tmp_path):
    keys = spark.createDataFrame([("reports/2025-01-01/b_report.md",)], "key STRING")
    source = stream(spark, events(spark), str(tmp_path / "in"), 2)
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.discovery_stream(source, keys).select("symbol"), out, str(tmp_path / "state"))
    assert rows(spark.read.parquet(out), "symbol") == [("A",), ("C",)]


def test_discovery_stream_loses_no_late_symbol(spark, tmp_path):
    keys = spark.createDataFrame([("reports/2025-01-01/q_report.md",)], "key STRING")
    days = [("A", 200), ("A", 210), ("B", 40), ("Z", 211), ("B", 212)]
    path = str(tmp_path / "in")
    for i, (symbol, day) in enumerate(days):
        one = spark.createDataFrame([(symbol, dt.datetime(2026, 1, 1) + dt.timedelta(days=day), i, "x")], EVENTS)
        one.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.discovery_stream(source, keys).select("symbol"), out, str(tmp_path / "state"))
    assert rows(spark.read.parquet(out), "symbol") == [("A",), ("B",), ("Z",)]


def test_gate_stream_keeps_one_row_of_a_key_in_one_batch(spark, tmp_path):
    both = docs(spark, a={"critique": None}, b={}).withColumn("symbol", F.lit("X")).withColumn("date", F.lit("2026-01-01").cast("date"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    both.coalesce(1).write.parquet(path)
    jobs.gate_stream(spark.readStream.schema(both.schema).parquet(path), out, str(tmp_path / "state"), "doc_key").awaitTermination()
    assert rows(spark.read.parquet(out), "symbol", "passed") == [("X", True)]


def test_gate_stream_replaces_by_key(spark, tmp_path):
    first = docs(spark, x={}, y={"critique": None}).withColumn("symbol", F.upper("doc_key")).withColumn("date", F.lit("2026-01-01").cast("date"))
    path = str(tmp_path / "in")
    first.coalesce(1).write.parquet(path)
    source = lambda: spark.readStream.schema(first.schema).parquet(path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    jobs.gate_stream(source(), out, state, "doc_key").awaitTermination()
    assert rows(spark.read.parquet(out), "symbol", "passed") == [("X", True), ("Y", False)]
    first.where("doc_key = 'y'").withColumn("critique", F.lit("done")).coalesce(1).write.mode("append").parquet(path)
    jobs.gate_stream(source(), out, state, "doc_key").awaitTermination()
    assert rows(spark.read.parquet(out), "symbol", "passed") == [("X", True), ("Y", True)]


def test_scratch_dir_follows_the_session():
    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert scratch_dir(session("/shared/run/", "yarn"), "x").startswith("/shared/run/x-")
    assert scratch_dir(session(None, "local[2]"), "x").startswith("/tmp/run-")
    with pytest.raises(ValueError):
        scratch_dir(session(None, "yarn"), "x")


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_queries_read_a_table_of_any_number_of_files(spark, tmp_path, files):
    from tickerloom.plans import load_all
    from tickerloom.plans.registry import QUERIES
    from tickerloom.plans.stream_queries import stream_of
    from tickerloom.plans.views import Views

    load_all()
    source = "/root/testdata/sf0.001"
    for table in ("documents", "pages", "labels"):
        df = spark.read.parquet(f"{source}/{table}.parquet")
        if table == "documents":
            df = df.where("doc_id < 12") if files else df.where("false")
        df.repartition(max(files, 1)).write.parquet(str(tmp_path / "in" / f"{table}.parquet"))
    (tmp_path / "in" / "documents.parquet.old").mkdir()
    want = spark.read.parquet(str(tmp_path / "in" / "documents.parquet")).count()
    assert QUERIES["t02_gate_stream"](spark, str(tmp_path / "in")).count() == want == (12 if files else 0)
    # One plain file works as before.
    out = str(tmp_path / "out")
    jobs.run_to_table(stream_of(Views(spark, source), "labels"), out, str(tmp_path / "state"))
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{source}/labels.parquet").count()
