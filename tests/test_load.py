"""CSV loading: schemas, typed rows, audit trail, failures, repeats."""

import datetime as dt
import random
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.operators import audit
from ledgerline.plans import leases, load
from ledgerline.plans.load import LoadSettings, load_files, load_notices
from ledgerline.sources import csv_files, tables


def settings(name, **more):
    return LoadSettings(database=name, **more)


def store(tmp_path, files):
    for name, content in files.items():
        path = tmp_path / "store" / "b" / "mba" / "csv" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    root = tmp_path / "store"
    return [(str(p), "b", str(p.relative_to(root / "b"))) for p in sorted(root.rglob("*.csv"))]


def run(spark, files, conf, batch="one"):
    df = spark.createDataFrame(files, "path string, bucket string, key string")
    return {r.key.rsplit("/", 1)[-1]: r for r in load_files(df, conf, batch).collect()}


MEMBERS = "Member ID,First Name,DOB,Joined At,Amount,Active,Note\nM1001,Brandi,2005-05-23,2024-01-05 10:00:00,1.50,yes,\nM1002, Anthony ,14-12-1987,2024-1-5T09:08:07,2,N,\"two\nlines\"\n"


def test_load_types_and_audit(spark, tmp_path):
    conf = settings("load_types")
    done = run(spark, store(tmp_path, {"Member-Data.csv": MEMBERS}), conf)
    result = done["Member-Data.csv"]
    assert (result.status, result.table_name, result.rows_inserted, result.delimiter) == ("success", "member_data", 2, ",")
    table = spark.table("load_types.member_data")
    kinds = {name: kind for name, kind, _ in tables.describe(spark, "load_types.member_data")}
    assert kinds == {
        "member_id": "string",
        "first_name": "string",
        "dob": "date",
        "joined_at": "timestamp_ntz",
        "amount": "decimal(38,10)",
        "active": "boolean",
        "note": "string",
        "load_batch": "string",
    }
    got = {r.member_id: r for r in table.collect()}
    assert got["M1002"].first_name == "Anthony"
    assert got["M1002"].dob == dt.date(1987, 12, 14)
    assert got["M1002"].joined_at == dt.datetime(2024, 1, 5, 9, 8, 7)
    assert got["M1001"].amount == Decimal("1.5") and got["M1001"].active is True
    assert got["M1001"].note is None and got["M1002"].note == "two\nlines"
    state = audit.audit_state(load.audit_events(spark, conf)).collect()
    assert [(s.status, s.rows_inserted, s.bytes, s.id) for s in state] == [
        ("SUCCESS", 2, len(MEMBERS), result.audit_id)
    ]
    assert state[0].duration_ms > 0


def test_repeat_is_skipped_and_rerun_repeats_nothing(spark, tmp_path):
    conf = settings("load_repeat")
    files = store(tmp_path, {"a.csv": "x,y\n1,2\n", "b.csv": "x\n5\n"})
    assert {r.status for r in run(spark, files, conf).values()} == {"success"}
    assert {r.status for r in run(spark, files, conf, "two").values()} == {"skipped"}
    assert spark.table("load_repeat.a").count() == 1
    # New content is added; a batch run again replaces only its own rows.
    more = store(tmp_path / "more", {"a.csv": "x,y\n3,4\n5,6\n"})
    always = settings("load_repeat", append_always=True)
    for _ in range(2):
        run(spark, more, always, "three")
    assert spark.table("load_repeat.a").count() == 3
    assert spark.table("load_repeat.b").count() == 1


def test_a_used_batch_name_replaces_nothing(spark, tmp_path):
    conf = settings("load_reused")
    run(spark, store(tmp_path / "1", {"a.csv": "x\n1\n"}), conf, "daily")
    run(spark, store(tmp_path / "2", {"a.csv": "x\n2\n"}), conf, "daily")
    assert sorted(r.x for r in spark.table("load_reused.a").collect()) == [1, 2]
    assert audit.audit_state(load.audit_events(spark, conf)).count() == 2


def test_one_bad_file_stops_no_other(spark, tmp_path):
    conf = settings("load_bad", sample_rows=500)
    good = "".join(f"{i},2024-01-05\n" for i in range(600))
    files = store(
        tmp_path,
        {
            "good.csv": "id,day\n" + good,
            "late.csv": "id,day\n" + good + "x,2024-01-05\n",
            "empty.csv": "",
            "clash.csv": "a b,a-b\n1,2\n",
            "only_header.csv": "p,q\n",
        },
    )
    files.append((str(tmp_path / "none.csv"), "b", "mba/csv/none.csv"))
    done = run(spark, files, conf)
    assert {k: r.status for k, r in done.items()} == {
        "good.csv": "success",
        "late.csv": "failed",
        "empty.csv": "failed",
        "clash.csv": "failed",
        "only_header.csv": "success",
        "none.csv": "failed",
    }
    assert done["good.csv"].rows_inserted == 600
    # The sample ends before the bad row, as the table's type does.
    assert "Incorrect bigint value for column 'id': x" in done["late.csv"].error_message
    assert "no header" in done["empty.csv"].error_message
    assert "share a column name" in done["clash.csv"].error_message
    assert spark.table("load_bad.late").count() == 0
    state = {s.table_name: s for s in audit.audit_state(load.audit_events(spark, conf)).collect()}
    assert state["late"].status == "FAILED" and "Incorrect" in state["late"].error_message
    assert state["late"].duration_ms is None
    # With a profile of the whole file, the column is text and the file loads.
    whole = settings("load_whole")
    assert run(spark, [f for f in files if "late" in f[0]], whole)["late.csv"].status == "success"


def test_second_file_follows_the_first_schema(spark, tmp_path):
    conf = settings("load_schema")
    run(spark, store(tmp_path / "1", {"t.csv": "a,b\n1,x\n"}), conf)
    for name, text, status in (
        ("2", "b,a\ny,2\n", "success"),
        ("3", "a,c\n1,2\n", "failed"),
        ("4", "b\nz\n", "failed"),
        ("5", "a;b\n7;w\n", "success"),
        ("6", "a,b\n8,longer than before\n", "success"),
    ):
        done = run(spark, store(tmp_path / name, {"t.csv": text}), conf, f"batch-{name}")
        assert done["t.csv"].status == status, (name, done)
    got = sorted((r.a, r.b) for r in spark.table("load_schema.t").collect())
    assert got == [(1, "x"), (2, "y"), (7, "w"), (8, "longer than before")]


def test_routed_tables(spark, tmp_path):
    files = store(
        tmp_path,
        {
            "MemberData_1.csv": "member_id\nM1\n",
            "PlanDetails.csv": "plan_name\n020213CA\n",
            "my_accumulator.csv": "member_id\nM1\n",
            "other.csv": "a\n1\n",
        },
    )
    done = run(spark, files, settings("load_routed", routed=True))
    assert {k: (r.table_name, r.status) for k, r in done.items()} == {
        "MemberData_1.csv": ("memberdata", "success"),
        "PlanDetails.csv": ("plan_details", "success"),
        "my_accumulator.csv": ("benefit_accumulator", "success"),
        "other.csv": (None, "failed"),
    }
    assert done["other.csv"].error_message == "Cannot route ETL for key: mba/csv/other.csv"


def test_row_hook(spark, tmp_path):
    conf = settings("load_hook", row_hook=lambda df: df.withColumn("name", F.upper("name")), multi_line=False)
    run(spark, store(tmp_path, {"h.csv": "name\nann\n\nbob\n"}), conf)
    assert sorted(r.name for r in spark.table("load_hook.h").collect()) == ["ANN", "BOB"]


def test_notices_end_to_end(spark, tmp_path):
    store(tmp_path, {"a.csv": "x\n1\n2\n"})
    upper = tmp_path / "store" / "b" / "MBA" / "CSV" / "b.CSV"
    upper.parent.mkdir(parents=True)
    upper.write_text("x\n3\n")
    keys = ["mba/csv/a.csv", "MBA/CSV/b.CSV", "policy/csv/c.csv", "mba/csv/d.pdf", None]
    records = [
        '{"s3":{"bucket":{"name":"b"},"object":{"key":"%s"}}}' % k if k else '{"s3":{"object":{"key":"mba/csv/e.csv"}}}'
        for k in keys
    ]
    bodies = [("r1", '{"Records":[%s]}' % ",".join(records)), ("r2", '{"Records":[]}'), ("r3", "{}")]
    results, summary = load_notices(
        spark.createDataFrame(bodies, "request_id string, body string"),
        str(tmp_path / "store"),
        settings("load_notices"),
        "n1",
    )
    got = {r.request_id: r for r in summary.collect()}
    r1 = got["r1"]
    assert (r1.files_processed, r1.files_failed, r1.files_skipped, r1.total_records) == (2, 1, 2, 5)
    assert (r1.success_rate_percent, r1.status_code, r1.total_rows_inserted) == (40.0, 207, 3)
    assert got["r2"].status_code == got["r3"].status_code == 400
    assert got["r2"].error == "No S3 records found in event"
    reasons = {r.key: r.reason for r in results.where("status IN ('skipped', 'failed')").collect()}
    assert reasons == {
        "policy/csv/c.csv": "Not in mba/csv/ prefix",
        "mba/csv/d.pdf": "Not a CSV file",
        "mba/csv/e.csv": "Missing bucket or key in S3 record",
    }


@pytest.mark.parametrize(
    "text, delimiter",
    [
        ("a,b\n1,2\n", ","),
        ("a;b\n1,5;2\n", ";"),
        ("a\tb\n1\t2\n", "\t"),
        ("a|b\n1|2\n", "|"),
        ("a\n1\n", ","),
        ('"x,y";b\n"1,2,3";2\n', ";"),
        ("a;b\n" + "1;2\n" * 20 + "3\n" + "4;5\n" * 20, ";"),
        ("a,b;c\n1,5;2\n3;4\n5;6\n", ";"),
        ('a|b\n"x\n,;y"|2\n', "|"),
        ("", ","),
    ],
)
def test_delimiters(spark, text, delimiter):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(csv_files.delimiter_of(F.col("t"))).first()[0] == delimiter


def test_lines_of_a_text_are_found_once(spark):
    df = spark.createDataFrame([("a;b\n1;2\n3;4",), (None,), ("",), ("\n\r\n",)], "t string")
    chosen = df.select(csv_files.delimiter_of(F.col("t")).alias("d"))
    assert [r.d for r in chosen.collect()] == [";", ",", ",", ","]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("split(") == 1


def test_files_of_parts_are_made_by_many_tasks(spark, tmp_path):
    rows = [(k, f"Brand#{k}", k % 50) for k in range(40)] + [(None, "Brand#1", 1), (3, "Brand#3", 3), (4, None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        found = entry.queries()["delimiter_choice"](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 5
        told = sorted((r.p_partkey, r.delimiter) for r in found.collect() if r.p_partkey is not None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = sorted([*range(40), 3, 4])
    assert told == [(k, "," if k % 10 == 3 else ",;\t|"[k % 4]) for k in keys]



@pytest.mark.parametrize("text", ["", "a;b\n" + "1;2\n" * 20 + "3\n", 'a|b\r\n"x\n,;y"|2\r\n', "a\tb\n\n\n1\t2", "x\n"])
def test_delimiter_of_files_and_of_texts_agree(spark, tmp_path, text):
    path = tmp_path / "f.csv"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([(str(path),), (str(tmp_path / "none.csv"),)], "path string")
    found = {r.path: r for r in csv_files.with_delimiter(files).collect()}
    assert found[str(path)].delimiter == spark.range(1).select(csv_files.delimiter_of(F.lit(text))).first()[0]
    assert found[str(tmp_path / "none.csv")].delimiter is None and found[str(tmp_path / "none.csv")].unread


def test_a_lost_run_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    """A run ends after its tables are written and before it says so."""
    conf = settings("load_lost")
    files = store(tmp_path, {"a.csv": "x\n1\n2\n", "b.csv": "y\n5\n"})
    append = load._append_events

    def lose(events, to, batch):
        if "SUCCESS" in {r.event for r in events.select("event").distinct().collect()}:
            raise KeyboardInterrupt
        append(events, to, batch)

    monkeypatch.setattr(load, "_append_events", lose)
    with pytest.raises(KeyboardInterrupt):
        run(spark, files, conf, "first")
    assert spark.table("load_lost.a").count() == 2
    monkeypatch.setattr(load, "_append_events", append)
    assert {r.status for r in run(spark, files[:1], conf, "second").values()} == {"success"}
    assert spark.table("load_lost.a").count() == 2
    assert {r.status for r in run(spark, files, conf, "third").values()} == {"success", "skipped"}
    assert (spark.table("load_lost.a").count(), spark.table("load_lost.b").count()) == (2, 1)


def test_a_bad_header_beside_a_good_file_of_one_table(spark, tmp_path):
    conf = settings("load_header")
    files = store(tmp_path / "1", {"t.csv": "a\n1\n"}) + store(tmp_path / "2", {"t.csv": "a a,a-a\n1,2\n"})
    df = spark.createDataFrame(files, "path string, bucket string, key string")
    done = {r.path: r for r in load_files(df, conf, "one").collect()}
    assert [done[f[0]].status for f in files] == ["success", "failed"]
    assert "share a column name" in done[files[1][0]].error_message
    assert spark.table("load_header.t").count() == 1


def test_a_file_that_vanishes_fails_alone(spark, tmp_path, monkeypatch):
    conf = settings("load_gone")
    files = store(tmp_path / "1", {"t.csv": "a\n1\n"}) + store(tmp_path / "2", {"t.csv": "a\n2\n"})
    check = load._ensure_table

    def vanish(*args):
        check(*args)
        (tmp_path / "2/store/b/mba/csv/t.csv").unlink(missing_ok=True)

    monkeypatch.setattr(load, "_ensure_table", vanish)
    df = spark.createDataFrame(files, "path string, bucket string, key string")
    done = {r.path: r.status for r in load_files(df, conf, "one").collect()}
    assert done == {files[0][0]: "success", files[1][0]: "failed"}
    assert [r.a for r in spark.table("load_gone.t").collect()] == [1]


def test_columns_named_as_the_job_names_its_own(spark, tmp_path):
    conf = settings("load_names")
    done = run(spark, store(tmp_path, {"t.csv": "a,Load Batch\n1,x\n"}), conf)
    assert done["t.csv"].status == "success", done
    assert [(r.a, r.load_batch_csv) for r in spark.table("load_names.t").collect()] == [(1, "x")]


def test_the_whole_first_file_decides_the_schema(spark, tmp_path):
    conf = settings("load_whole_file")
    text = "n\n" + "1\n" * 600 + "word\n" + "x" * 140_000 + "\n"
    done = run(spark, store(tmp_path, {"t.csv": text}), conf)
    assert (done["t.csv"].status, done["t.csv"].rows_inserted) == ("success", 602)


def in_thread(work):
    """Run ``work`` beside the test; its result by ``join``."""
    found = []
    thread = threading.Thread(target=lambda: found.append(work()))
    thread.start()

    def join():
        thread.join(120)
        assert not thread.is_alive()
        return found[0]

    return thread, join


def test_overlapping_loads_do_not_destroy_each_other(spark, tmp_path, monkeypatch):
    """Run two wants a file that run one, which loads another one too, is about to publish."""
    conf = settings("load_overlap")
    files = store(tmp_path, {"a/t.csv": "v\n1\n2\n", "b/t.csv": "v\n3\n4\n", "c/t.csv": "v\n5\n"})
    publish, at_work, go_on = load._publish, threading.Event(), threading.Event()

    def slow(rows, table, part):
        if table.endswith("`t`") and part["load_batch"].startswith("one-"):
            at_work.set()
            assert go_on.wait(60)
        publish(rows, table, part)

    monkeypatch.setattr(load, "_publish", slow)
    _, first = in_thread(lambda: run_paths(spark, files[:2], conf, "one"))
    assert at_work.wait(60)
    waiting, second = in_thread(lambda: run_paths(spark, files[:1], conf, "two"))
    # A run that wants nothing of it does not wait.
    assert run_paths(spark, files[2:], conf, "three") == {files[2][0]: "success"}
    assert waiting.is_alive()
    go_on.set()
    assert first() == {f[0]: "success" for f in files[:2]}
    assert second() == {files[0][0]: "skipped"}
    assert sorted(r.v for r in spark.table("load_overlap.t").collect()) == [1, 2, 3, 4, 5]
    state = audit.audit_state(load.audit_events(spark, conf)).collect()
    assert sorted((s.status, s.rows_inserted) for s in state) == [("SUCCESS", 1), ("SUCCESS", 2), ("SUCCESS", 2)]


def run_paths(spark, files, conf, batch):
    df = spark.createDataFrame(files, "path string, bucket string, key string")
    return {r.path: r.status for r in load_files(df, conf, batch).collect()}


def test_loads_side_by_side(spark, tmp_path):
    """Runs of other files write to one table at a time; runs of one file load it once."""
    conf = settings("load_beside")
    files = store(tmp_path, {f"{k}/t.csv": f"v\n{k}\n" for k in range(3)})
    run_paths(spark, store(tmp_path / "first", {"t.csv": "v\n9\n"}), conf, "first")
    joins = [in_thread(lambda k=k: run_paths(spark, files[k % 3 : k % 3 + 1], conf, f"b{k}"))[1] for k in range(4)]
    statuses = [status for join in joins for status in join().values()]
    assert sorted(statuses) == ["skipped", "success", "success", "success"]
    assert sorted(r.v for r in spark.table("load_beside.t").collect()) == [0, 1, 2, 9]


def folder_of(spark, conf):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {conf.database}")
    return leases.Folder(spark, f"{load._database_folder(spark, conf)}/_load_runs")


def test_a_lost_lease_is_swept_and_a_slow_run_notices(spark, tmp_path, monkeypatch):
    conf = settings("load_slow")
    files = store(tmp_path, {"t.csv": "v\n1\n"})
    publish = load._publish

    def swept(rows, table, part):
        publish(rows, table, part)
        if table.endswith("`t`"):  # meanwhile another run has taken this one for lost
            folder = folder_of(spark, conf)
            for name in folder.names():
                folder.remove(name)

    monkeypatch.setattr(load, "_publish", swept)
    with pytest.raises(leases.LeaseLost):
        run_paths(spark, files, conf, "one")
    assert spark.table("load_slow.t").count() == 0
    monkeypatch.setattr(load, "_publish", publish)
    assert run_paths(spark, files, conf, "two") == {files[0][0]: "success"}
    assert spark.table("load_slow.t").count() == 1


def test_leases(spark):
    conf = settings("load_leases")
    folder = folder_of(spark, conf)
    wanted = spark.createDataFrame([("t", "m1")], "table_name string, md5 string")
    dead = leases.Lease(folder, 1.0)  # its driver never renews it
    with leases.Lease(folder, 1.0) as second:
        assert second.number == dead.number + 1
        began = time.monotonic()
        second.claim(wanted)  # waits until the first counts as lost
        assert 0.3 < time.monotonic() - began < 30
        assert not dead.held()
        with pytest.raises(leases.LeaseLost):
            dead.check()
        with leases.Lease(folder, 60.0) as third:
            third.claim(spark.createDataFrame([("t", "m2")], "table_name string, md5 string"))
        time.sleep(2)
        second.check()  # it has been renewed
    assert folder.names() == {}
    assert folder.create("x") and not folder.create("x")


@pytest.mark.parametrize("text", ["", "a;b\n" + "1;2\n" * 20 + "3\n", 'a|b\r\n"x\n,;y"|2\r\n' * 5, "a\tb\n\n\n1\t2", '"' + "x,y\n" * 9 + '"|b\n1|2\n'])
def test_delimiter_from_splits(spark, tmp_path, text):
    path = tmp_path / "f.csv"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([(str(path),)], "path string")
    for size in (1, 5, 1000):
        assert csv_files.with_delimiter(files, split_bytes=size).first().delimiter == csv_files.with_delimiter(files).first().delimiter


def test_line_counts_merge():
    rng = random.Random(3)
    for _ in range(400):
        data = "".join(rng.choice('ab,;"\n\r|') for _ in range(rng.randint(0, 40))).encode()
        cuts = sorted([0, len(data), *(rng.randint(0, len(data)) for _ in range(3))])
        whole = csv_files.LineCounts()
        whole.feed(data)
        merged = csv_files.LineCounts()
        for a, b in zip(cuts, cuts[1:]):
            part = csv_files.LineCounts(merged.quoted)
            part.feed(data[a:b])
            merged.follow(csv_files.LineCounts.from_json(part.to_json()))
        assert merged.whole() == whole.whole(), (data, cuts)


def test_audit_events_of_ended_runs_are_put_together(spark, tmp_path, monkeypatch):
    conf = settings("load_compact", compact_after=4)
    monkeypatch.setattr(load, "MOST_ARCHIVES", 1)
    lost = spark.createDataFrame([("z", "b", "k", "t", "m", 1, None)], "id string, bucket string, key string, table_name string, md5 string, bytes long, request_id string")
    load.tables.create_database(spark, conf.database)
    load._append_events(audit.started(lost, F.lit(dt.datetime(2024, 1, 1))), conf, "lost")
    for k in range(5):
        text = f"x\n{k}\n" if k != 2 else "a a,a-a\n1,2\n"
        run(spark, store(tmp_path / str(k), {"t.csv": text}), conf, f"b{k}")
        assert spark.sql("SHOW PARTITIONS load_compact.ingestion_audit_events").count() <= 6
    events = spark.table("load_compact.ingestion_audit_events")
    batches = {r.load_batch.split("-")[0] for r in events.select("load_batch").distinct().collect()}
    assert "archive" in batches and "lost" in batches
    state = audit.audit_state(load.audit_events(spark, conf)).collect()
    assert sorted(s.status for s in state) == ["FAILED", "STARTED"] + ["SUCCESS"] * 4
    # What the archive tells of is known.
    assert run(spark, store(tmp_path / "0", {"t.csv": "x\n0\n"}), conf, "again")["t.csv"].status == "skipped"
    assert spark.table("load_compact.t").count() == 4
