from tests.helpers import rows
from tickerloom.sources import artifacts, landed
from tickerloom.sources.catalog import BY_NAME, DATASETS, names_with_shape

PAYLOADS = [
    (1, '[{"symbol":"QUIX","date":"2026-05-09"}]'), (2, "[]"), (3, '{"unexpected":"shape"}'),
    (4, '{"symbol":"AAPL","historical":[{"date":"2026-01-15","close":42.0},{"date":"2026-01-16"}]}'),
    (5, '{"error":"rate limited"}'), (6, None), (7, '[{"a":1},5]'), (8, "7"), (9, "{bad"), (10, "null"),
    (11, '{"Error Message":"no"}'), (12, '{"error":""}'), (13, '{"historical":5}'),
]


def frame(spark):
    return spark.createDataFrame(PAYLOADS, "event_id INT, payload STRING")


def found(df):
    return {r["event_id"]: (r["row_error"], len(r["rows"])) for r in df.collect()}


def test_strict_rows(spark):
    assert found(landed.list_rows(frame(spark))) == {
        1: (None, 1), 2: (None, 0), 3: (None, 1), 4: (None, 1), 5: ("vendor_error: rate limited", 0), 6: (None, 0),
        7: ("non_object_entries", 0), 8: ("unexpected_type", 0), 9: ("invalid_json", 0), 10: (None, 0),
        11: ("vendor_error: no", 0), 12: (None, 1), 13: (None, 1)}


def test_historical_rows(spark):
    out = found(landed.historical_rows(frame(spark)))
    assert out[1] == (None, 1) and out[2] == (None, 0) and out[4] == (None, 2)
    assert out[3] == out[6] == out[8] == out[10] == out[13] == ("unexpected_shape", 0)
    assert out[7] == ("non_object_entries", 0)


def test_lenient_rows(spark):
    out = {k: n for k, (_, n) in found(landed.lenient_rows(frame(spark))).items()}
    assert (out[1], out[2], out[3], out[6], out[7], out[8]) == (1, 0, 1, 0, 2, 0)


def test_rows_keep_their_order_and_errors_are_quarantined(spark):
    normalized = landed.historical_rows(frame(spark))
    exploded = landed.explode_rows(normalized.where("event_id = 4"), "event_id")
    assert [r["ord"] for r in exploded.orderBy("ord").collect()] == [0, 1]
    good, bad = landed.split_vendor_errors(frame(spark))
    assert rows(bad, "event_id") == [(11,), (5,), (9,)]
    assert good.count() + bad.count() == len(PAYLOADS)
    assert landed.error_table(normalized, "event_id").count() == 10  # all but 1, 2 and 4


def test_dataset_catalog():
    assert len(DATASETS) == 43 and len(BY_NAME) == 43
    assert BY_NAME["income-statement"].limit == 8
    assert names_with_shape("historical") == ["historical-price-eod/full"]


def test_artifact_listing_and_reads(spark, tmp_path):
    folder = tmp_path / "reports" / "2026-01-01"
    folder.mkdir(parents=True)
    (folder / "BRK.B_report.md").write_bytes("中文".encode() + b"\xff")
    (folder / "notes.tmp").write_text("x")
    keys = artifacts.list_artifacts(spark, str(tmp_path))
    assert rows(keys, "key") == [("reports/2026-01-01/BRK.B_report.md",), ("reports/2026-01-01/notes.tmp",)]
    assert rows(artifacts.parse_report_keys(keys), "date", "symbol") == [("2026-01-01", "BRK.B")]
    docs = artifacts.read_documents(spark, str(folder)).where("path like '%md'")
    assert docs.first()["text"] == "中文�"


def test_read_landed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"dataset":"quote","symbol":"A","http_status":200,"payload":"{bad"}\n')
    row = artifacts.read_landed_json(spark, str(tmp_path)).first()
    assert (row["dataset"], row["payload"]) == ("quote", "{bad")


def test_shapes_come_without_a_schema_of_the_whole_list(spark):
    from tests.helpers import plan_of
    from tickerloom.sources import landed as rules

    texts = [None, "null", " \n[1]", "[]", "\t{}", '{"a": 1}', "[{}, null]", "[{}, [1]]", '[{"a": 1}, {}]', '"[x"', "-3", "[1", "{} x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    listed = rules.list_rows(df)
    got = [(r.kind, r.row_error, r.n) for r in listed.selectExpr("i", "kind", "row_error", "size(rows) n").orderBy("i").collect()]
    assert got == [
        ("missing", None, 0), ("null", None, 0), ("list", "non_object_entries", 0), ("list", None, 0), ("object", None, 1), ("object", None, 1),
        ("list", "non_object_entries", 0), ("list", "non_object_entries", 0), ("list", None, 2), ("scalar", "unexpected_type", 0),
        ("scalar", "unexpected_type", 0), ("missing", "invalid_json", 0), ("missing", "invalid_json", 0)]
    assert "schema_of_variant" not in plan_of(rules.explode_rows(listed, "i"))
