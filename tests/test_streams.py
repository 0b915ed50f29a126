"""Streams against the batch forms of the same operators."""

import datetime as dt

from ledgerline.operators import audit
from ledgerline.plans import load
from ledgerline.plans.load import LoadSettings
from ledgerline.streaming import counters, ingest


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_stream_loads(spark, tmp_path):
    root, checkpoint = tmp_path / "store", str(tmp_path / "checkpoint")
    conf = LoadSettings(database="stream_loads")
    put(root, "b/mba/csv/t.csv", "x\n1\n2\n")
    put(root, "b/mba/csv/bad.csv", "a a,a-a\n1,2\n")
    put(root, "b/policy/csv/no.csv", "x\n9\n")
    ingest.stream_loads(spark, str(root), conf, checkpoint).awaitTermination()
    assert spark.table("stream_loads.t").count() == 2
    assert not spark.catalog.tableExists("stream_loads.no")
    # New files only; the same content under another name of the table is skipped.
    put(root, "b/mba/csv/more/t.csv", "x\n3\n")
    put(root, "b2/mba/csv/t.csv", "x\n1\n2\n")
    ingest.stream_loads(spark, str(root), conf, checkpoint, per_trigger=1).awaitTermination()
    assert sorted(r.x for r in spark.table("stream_loads.t").collect()) == [1, 2, 3]
    state = audit.audit_state(load.audit_events(spark, conf)).collect()
    assert sorted((s.table_name, s.status) for s in state) == [("bad", "FAILED"), ("t", "SUCCESS"), ("t", "SUCCESS")]


def test_stream_plans(spark, tmp_path):
    root, target = tmp_path / "in", str(tmp_path / "plans")
    listing = spark.createDataFrame(
        [("mba-bucket", "mba/csv/a.csv", 2, None, "e")],
        "bucket string, key string, size long, last_modified timestamp_ntz, etag string",
    )
    put(root, "mba/a.csv", "12")
    put(root, "mba/b.csv", "12")
    ingest.stream_plans(spark, str(root), listing, target, str(tmp_path / "cp")).awaitTermination()
    put(root, "other/c.csv", "1")
    ingest.stream_plans(spark, str(root), listing, target, str(tmp_path / "cp")).awaitTermination()
    got = {r.path.rsplit("/", 1)[-1]: r.action for r in spark.read.parquet(target).collect()}
    assert got == {"a.csv": "skip", "b.csv": "upload", "c.csv": "fail"}


def test_live_counts(spark, tmp_path):
    path = str(tmp_path / "history")
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=7 * i), ("success", "failed", "skipped")[i % 3], i) for i in range(60)]
    history = spark.createDataFrame(rows, "timestamp timestamp_ntz, status string, size long")
    history.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(history.schema).parquet(path)

    def run(df, mode, name):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return {tuple(r) for r in spark.table(name).collect()}

    batch = {tuple(r) for r in counters.live_counts(history).collect()}
    assert run(counters.live_counts(stream), "complete", "live_complete") == batch
    # In append mode the windows the watermark has not passed are still open.
    closed = run(counters.live_counts(stream), "append", "live_append")
    assert closed < batch and len(closed) > len(batch) / 2
    totals = {tuple(r) for r in counters.live_totals(history).collect()}
    assert run(counters.live_totals(stream), "complete", "live_totals") == totals


def test_streams_lose_no_hidden_files(spark, tmp_path):
    root, checkpoint = tmp_path / "store", str(tmp_path / "cp")
    conf = LoadSettings(database="stream_hidden")
    put(root, "b/mba/csv/_first.csv", "x\n1\n")
    ingest.stream_loads(spark, str(root), conf, checkpoint).awaitTermination()
    put(root, "b/mba/csv/.dot.csv", "x\n5\n")
    put(root, "b/mba/csv/t.csv", "x\n2\n")
    put(root, "b/mba/csv/_bad.csv", "a a,a-a\n1,2\n")
    for _ in range(2):
        ingest.stream_loads(spark, str(root), conf, checkpoint).awaitTermination()
    state = audit.audit_state(load.audit_events(spark, conf)).collect()
    found = sorted((s.s3_key.rpartition("/")[2], s.status) for s in state)
    assert found == [(".dot.csv", "SUCCESS"), ("_bad.csv", "FAILED"), ("_first.csv", "SUCCESS"), ("t.csv", "SUCCESS")]
    by_key = {s.s3_key.rpartition("/")[2]: s.table_name for s in state}
    assert [r.x for r in spark.table(f"stream_hidden.{by_key['_first.csv']}").collect()] == [1]


def test_stream_plans_of_hidden_files(spark, tmp_path):
    root, target = tmp_path / "in", str(tmp_path / "plans")
    listing = spark.createDataFrame([], "bucket string, key string, size long, last_modified timestamp_ntz, etag string")
    put(root, "mba/a.csv", "12")
    put(root, "mba/_b.csv", "12")
    for _ in range(2):
        ingest.stream_plans(spark, str(root), listing, target, str(tmp_path / "cp")).awaitTermination()
    names = [r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(target).collect()]
    assert sorted(names) == ["_b.csv", "a.csv"]
