"""Audit trail, upload history, job states, notices, catalog tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, history, notices
from ledgerline.sources import notices as notice_source
from ledgerline.sources import tables

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
LOADS = "id string, bucket string, key string, table_name string, md5 string, bytes long, request_id string"


def later(minutes):
    return F.lit(T0 + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def events(spark):
    loads = spark.createDataFrame(
        [(i, "b" * 300, f"k/{i}.csv", "t" * 300, "0" * 32, 10, "r" * 100) for i in "abcd"], LOADS
    )
    ok = spark.createDataFrame([("b", 7, 1200)], "id string, rows_inserted long, duration_ms int")
    bad = spark.createDataFrame(
        [("c", "x" * 5000, 2), ("d", "", None), ("ghost", "never started", 0)],
        "id string, error_message string, retry_count int",
    )
    again = spark.createDataFrame([("d", 3, 5)], "id string, rows_inserted long, duration_ms int")
    return (
        audit.started(loads, later(0))
        .unionByName(audit.succeeded(ok, later(1)))
        .unionByName(audit.failed(bad, later(2)))
        .unionByName(audit.succeeded(again, later(2)))
    )


def test_audit_state(events):
    got = {r.id: r for r in audit.audit_state(events).collect()}
    assert set(got) == set("abcd")
    assert (got["a"].status, got["a"].finished_at, got["a"].retry_count) == ("STARTED", None, 0)
    assert (len(got["a"].s3_bucket), len(got["a"].table_name), len(got["a"].lambda_request_id)) == (255, 255, 64)
    assert (got["b"].status, got["b"].rows_inserted, got["b"].duration_ms) == ("SUCCESS", 7, 1200)
    assert (got["c"].status, len(got["c"].error_message), got["c"].retry_count) == ("FAILED", 4000, 2)
    assert got["c"].duration_ms is None
    # A success clears the error; of one time, it is the later event.
    assert (got["d"].status, got["d"].error_message, got["d"].started_at) == ("SUCCESS", None, T0)


def test_audit_views(spark, events):
    state = audit.audit_state(events)
    recent = audit.recent_audits(state, 3).collect()
    assert [r.audit_id for r in recent] == ["a", "b", "c"]
    assert recent[2].error_message == "x" * 100 + "..." and recent[0].started_at == "2024-03-01T12:00:00"
    shown = {r.audit_id: r for r in audit.browse_audits(state).collect()}
    assert len(shown["c"].error) == 180 and shown["a"].error == "" and shown["a"].rows_inserted == 0
    asked = spark.createDataFrame([(1, "b"), (2, "none"), (3, "b")], "request_id int, audit_id string")
    found = {r.request_id: (r.audit_id, r.status) for r in audit.audit_lookup(asked, state).collect()}
    assert found == {1: ("b", "SUCCESS"), 2: ("none", "not_found"), 3: ("b", "SUCCESS")}


@pytest.mark.parametrize("change", [{"bucket": ""}, {"md5": None}, {"bytes": -1}])
def test_audit_checks(spark, change):
    row = {"id": "a", "bucket": "b", "key": "k", "table_name": "t", "md5": "m", "bytes": 1, "request_id": None, **change}
    df = spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in LOADS.split(", "))], LOADS)
    with pytest.raises(Exception, match="required|negative"):
        audit.started(df, later(0)).collect()


def test_audit_finish_checks(spark):
    for row in [("", 1, 1), ("a", -1, 1), ("a", 1, -1)]:
        df = spark.createDataFrame([row], "id string, rows_inserted long, duration_ms int")
        with pytest.raises(Exception, match="required|negative"):
            audit.succeeded(df, later(0)).collect()
    blank = spark.createDataFrame([(None, "e", 0)], "id string, error_message string, retry_count int")
    with pytest.raises(Exception, match="required"):
        audit.failed(blank, later(0)).collect()


def results(spark):
    rows = [
        ("/in/mba/a.csv", True, "Uploaded to s3://b/mba/csv/a.csv", 1048576, T0),
        ("/in/mba/b.csv", True, "Skipped - already in S3: mba/csv/b.csv", 5, T0 + dt.timedelta(hours=1)),
        ("/in/x/c.csv", False, "Error: s3://one then s3://two", None, T0 + dt.timedelta(days=1)),
        ("/in/policy/d.csv", True, "s3://b/dry", 7, T0 + dt.timedelta(days=1)),
    ]
    return spark.createDataFrame(rows, "path string, success boolean, message string, size long, ts timestamp_ntz")


def test_history(spark, rows, tmp_path):
    records = history.upload_records(results(spark), "/in")
    assert rows(records, "scope", "s3_key", "status", "size") == [
        ("mba", "", "skipped", 5),
        ("mba", "b/mba/csv/a.csv", "success", 1048576),
        ("policy", "b/dry", "success", 7),
        ("unknown", "two", "failed", 0),
    ]
    stats = history.batch_stats(records).first()
    assert (stats.total, stats.uploaded, stats.skipped, stats.failed, stats.success_rate) == (4, 2, 1, 1, 75.0)
    assert history.batch_stats(records.where("false")).first().success_rate is None
    totals = history.running_totals(records).first()
    assert (totals.total_size, totals.total_mb) == (1048583, 1048583 / 1048576)
    assert history.running_totals(records.where("false")).first().total_size == 0
    rate = {str(r.date): r.success_rate for r in history.daily_success_rate(records).collect()}
    assert rate == {"2024-03-01": 50.0, "2024-03-02": 50.0}
    assert history.daily_trend(records, "2024-03-02", "2024-03-02").count() == 2
    assert rows(history.hourly_activity(records)) == [(12, "failed", 1), (12, "success", 2), (13, "skipped", 1)]
    assert [r.file_path for r in history.latest(records, 2).collect()] == ["/in/x/c.csv", "/in/policy/d.csv"]
    path = str(tmp_path / "export")
    history.export_history(records, path, n=3)
    kept = history.import_history(spark, path)
    assert kept.columns == records.columns and kept.count() == 3
    assert kept.where("file_path = '/in/mba/a.csv'").isEmpty()
    oldest = history.export_rows(records, 1, oldest=True).first()
    assert oldest.file_path == "/in/mba/a.csv" and oldest.timestamp == T0


def test_jobs(spark, rows):
    events = [("j1", "queued", T0, 1), ("j1", "failed", T0, 2), ("j2", "processed", T0, 3), ("j3", "queued", T0, 4)]
    got = history.job_states(spark.createDataFrame(events, "job string, state string, ts timestamp_ntz, seq int")).first()
    assert tuple(got) == (1, 1, 1, 3)
    done = spark.createDataFrame([("w1", "processed"), ("w1", "failed"), ("w2", "queued")], "worker string, state string")
    assert rows(history.worker_totals(done)) == [("all", 1, 1, 50.0), ("w1", 1, 1, 50.0), ("w2", 0, 0, None)]


def test_notices(spark):
    bodies = [
        (1, '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"MBA/csv/A.CSV"}}},{"s3":{"bucket":{"name":""},"object":{"key":"k"}}}]}'),
        (2, '{"Records":[]}'),
        (3, "not json"),
        (4, '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"mba/csv/a%20b.csv"}}}]}'),
    ]
    df = spark.createDataFrame(bodies, "request_id int, body string")
    got = notices.select_records(notice_source.parse_notices(df)).collect()
    assert sorted((r.request_id, r.record_index, r.key, r.status) for r in got if r.key) == [
        (1, 0, "MBA/csv/A.CSV", "load"),
        (1, 1, "k", "failed"),
        (4, 0, "mba/csv/a%20b.csv", "load"),
    ]
    assert {r.request_id for r in got if r.status is None} == {2, 3}


def test_tables(spark, rows):
    tables.create_database(spark, "catalog_test")
    name = "catalog_test.memberdata"
    new = spark.createDataFrame([("M1", 3)], "member_id string, n int")
    assert tables.append_rows(new, name) == 1
    assert tables.append_rows(new.where("false"), name) == 0
    assert tables.append_rows(new.union(new), name) == 2
    assert rows(tables.catalog_counts(spark, [name, "catalog_test.absent"])) == [
        ("catalog_test.absent", 0),
        (name, 3),
    ]
    assert tables.has_columns(spark, name, ["member_id", "plan_name"]) == {"member_id": True, "plan_name": False}
    assert tables.select(spark, f"SELECT * FROM {name} WHERE member_id = :m", {"m": "M1"}).count() == 3
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        tables.select(spark, "SELECT * FROM catalog_test.absent").collect()
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:none", "t", partition_column="id")
