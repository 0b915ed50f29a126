"""Files: discovery, hashes, duplicates, comparison with a listing, plans."""

import datetime as dt
import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import duplicates, inventory, remote
from ledgerline.plans import transfer
from ledgerline.sources import csv_files
from ledgerline.sources import files as file_source

DAY = dt.datetime(2024, 1, 1)
HASHED = "path string, size long, modified timestamp_ntz, hash string"
LISTED = "bucket string, key string, size long, last_modified timestamp_ntz, etag string"


def make(root, files):
    for i, (name, content) in enumerate(files.items()):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)


TREE = {
    "mba/csv/x.csv": b"same",
    "policy/a/b.docx": b"other",
    "misc/mba/y.txt": b"same",
    "A.PDF": b"same",
    ".env": b"secret",
    "noext": b"n",
    "misc/_hidden.csv": b"same",
    "misc/.dot.txt": b"dot",
}


def test_discovery(spark, tmp_path, rows):
    make(tmp_path, TREE)
    root = str(tmp_path)
    listed = rows(file_source.list_files(spark, root), "path")
    assert listed == sorted((f"{root}/{n}",) for n in TREE)
    assert len(rows(file_source.list_files(spark, root, recursive=False))) == 3
    found = {r.path[len(root) + 1 :]: (r.category, r.scope) for r in file_source.discover_files(spark, root).collect()}
    assert found == {
        "mba/csv/x.csv": ("csv", "mba"),
        "policy/a/b.docx": ("docx", "policy"),
        "misc/mba/y.txt": ("text", "mba"),
        "A.PDF": ("pdf", None),
        "misc/_hidden.csv": ("csv", None),
        "misc/.dot.txt": ("text", None),
    }
    some = file_source.discover_files(spark, root, include={"csv", ".txt"}, exclude={".txt"})
    assert {r.path[len(root) + 1 :] for r in some.collect()} == {"mba/csv/x.csv", "misc/_hidden.csv"}
    # Extensions are compared as given: an upper-case entry matches nothing.
    assert file_source.discover_files(spark, root, include={"PDF"}).isEmpty()
    assert file_source.discover_files(spark, root, scope="mba").count() == 1
    assert file_source.discover_files(spark, root, scope="none").count() == 6
    with pytest.raises(FileNotFoundError):
        file_source.list_files(spark, f"{root}/absent")
    with pytest.raises(NotADirectoryError):
        file_source.list_files(spark, f"{root}/A.PDF")


def test_scope_filter_on_rows(spark, tmp_path):
    files = spark.createDataFrame([("/d/mba/a.csv",), ("/d/x/b.csv",)], "path string")
    assert inventory.in_scope(files, "/d", "mba").count() == 1
    assert inventory.in_scope(files, "/d", "policy").count() == 2
    assert inventory.in_scope(files, "/d", None).count() == 2


def test_hashes_and_saved_state(spark, tmp_path):
    tree, state = tmp_path / "tree", str(tmp_path / "state")
    make(tree, TREE)
    first = {r.path: r.hash for r in file_source.refresh_hashes(spark, str(tree), state).collect()}
    assert first == {f"{tree}/{n}": hashlib.md5(c).hexdigest() for n, c in TREE.items()}
    # Same size and time: the saved hash stands. New time: the file is read.
    before = (tree / "noext").stat().st_mtime
    (tree / "noext").write_bytes(b"m")
    os.utime(tree / "noext", (before, before))
    (tree / "A.PDF").write_bytes(b"eman")
    (tree / "new.txt").write_bytes(b"new")
    second = {r.path: r.hash for r in file_source.refresh_hashes(spark, str(tree), state).collect()}
    assert second[f"{tree}/noext"] == first[f"{tree}/noext"]
    assert second[f"{tree}/A.PDF"] == hashlib.md5(b"eman").hexdigest()
    assert len(second) == len(first) + 1
    assert file_source.read_hash_state(spark, state).count() == len(second)
    files = spark.createDataFrame([(f"{tree}/A.PDF",), (f"{tree}/gone",)], "path string")
    digests = {r.path: r.hash for r in file_source.hash_files(files, "sha256").collect()}
    assert digests == {f"{tree}/A.PDF": hashlib.sha256(b"eman").hexdigest(), f"{tree}/gone": ""}


def test_hash_state_in_changes(spark, tmp_path, monkeypatch):
    """A refresh writes what changed; many changes become one base; old folders go."""
    tree, state = tmp_path / "tree", tmp_path / "state"
    make(tree, {f"{k}.txt": str(k).encode() for k in range(20)})
    monkeypatch.setattr(file_source, "MOST_CHANGES", 4)
    rows = lambda n: spark.read.parquet(str(state / f"change={n}")).count()

    def check():
        got = {r.path: r.hash for r in file_source.refresh_hashes(spark, str(tree), str(state)).collect()}
        assert got == {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in tree.iterdir()}

    check()
    assert rows(1) == 20
    (tree / "3.txt").write_bytes(b"longer")
    (tree / "4.txt").unlink()
    make(tree, {"new.txt": b"n"})
    check()
    assert rows(2) == 3
    check()
    assert rows(3) == 0
    (tree / "4.txt").write_bytes(b"again")
    check()
    assert sorted(p.name for p in state.iterdir()) == ["change=1", "change=2", "change=3", "change=4", "version=4"]
    for k in range(4):
        make(tree, {f"more{k}.txt": b"m"})
        check()
    assert sorted(p.name for p in state.iterdir()) == ["change=5", "change=6", "change=7", "change=8", "version=4", "version=8"]


def skewed_files():
    """A third of the files are copies of one content; some cannot be read."""
    rng = random.Random(3)
    out = []
    for i in range(900):
        content = "hot" if i % 3 == 0 else f"c{rng.randint(0, 350)}"
        digest = "" if i % 50 == 7 else hashlib.md5(content.encode()).hexdigest()
        out.append((f"/d/{i:04d}.txt", len(content), DAY + dt.timedelta(minutes=rng.randint(0, 40)), digest))
    return out


def test_duplicates_against_plain_python(spark):
    files = skewed_files()
    df = spark.createDataFrame(files, HASHED)
    groups = defaultdict(list)
    for path, size, when, digest in files:
        if digest:
            groups[digest].append((when, path, size))
    multiple = {h: sorted(v) for h, v in groups.items() if len(v) > 1}
    number = {h: i for i, h in enumerate(sorted(multiple), 1)}
    got = {r.path: (r.group_no, r.copies, r.marker) for r in duplicates.duplicate_groups(df).collect()}
    want = {
        path: (number[h], len(v), "oldest" if i == 0 else "duplicate")
        for h, v in multiple.items()
        for i, (_, path, _) in enumerate(v)
    }
    assert got == want
    stats = duplicates.duplicate_stats(df).first()
    assert stats.groups == len(multiple)
    assert stats.total_duplicates == sum(len(v) - 1 for v in multiple.values())
    assert stats.wasted_mb == sum(s for v in multiple.values() for _, _, s in v[1:]) / 1048576
    counts = {r.path: (r.partners, r.oldest_path) for r in duplicates.partner_counts(df).collect()}
    assert counts == {
        p: (len(groups[h]) - 1, min(groups[h])[1] if len(groups[h]) > 1 else None) for p, _, _, h in files if h
    }
    target = spark.createDataFrame([("/d/0000.txt",)], "target_path string")
    partners = {r.path for r in duplicates.partners_of(df, target).collect()}
    hot = hashlib.md5(b"hot").hexdigest()
    assert partners == {p for _, p, _ in groups[hot]} - {"/d/0000.txt"}


def test_report_text(spark):
    files = [
        ("/d/b.txt", 1500, DAY + dt.timedelta(days=1), "aa"),
        ("/d/s/a.txt", 1500, DAY, "aa"),
        ("/else/c.txt", 1500, DAY + dt.timedelta(days=2), "aa"),
        ("/d/u.txt", 7, DAY, "bb"),
    ]
    df = spark.createDataFrame(files, HASHED)
    lines = [r.text for r in duplicates.duplicate_report(df, "/d").orderBy(*duplicates.REPORT_ORDER).collect()]
    rule = "=" * 50
    assert lines == [
        rule,
        "Duplicate Detection Report",
        rule,
        "Found 2 duplicate files in 1 groups",
        "",
        "Group 1 (3 files):",
        "  - s/a.txt (oldest)",
        "    Size: 1,500 bytes",
        "    Modified: 2024-01-01 00:00:00",
        "  - b.txt (duplicate)",
        "    Size: 1,500 bytes",
        "    Modified: 2024-01-02 00:00:00",
        "  - c.txt (duplicate)",
        "    Size: 1,500 bytes",
        "    Modified: 2024-01-03 00:00:00",
        "",
        rule,
    ]
    none = duplicates.duplicate_report(df.where("hash = 'bb'")).orderBy(*duplicates.REPORT_ORDER).collect()
    assert [r.text for r in none] == [rule, "Duplicate Detection Report", rule, "No duplicates found", rule]


def listing(spark):
    return spark.createDataFrame(
        [
            ("mba-bucket", "mba/csv/same.csv", 4, DAY, '"e1"'),
            ("mba-bucket", "mba/csv/same.csv", 4, DAY, '"e1"'),
            ("mba-bucket", "mba/csv/other.csv", 9, DAY, '"e2"'),
            ("mba-bucket", "old/SAME.CSV", 5, DAY, '"e3"'),
            ("policy-bucket", "policy/text/sized.txt", 4, DAY, '"e4"'),
        ],
        LISTED,
    )


def test_comparison_and_plan(spark):
    files = spark.createDataFrame(
        [("/in/mba/same.csv", 4), ("/in/mba/other.csv", 4), ("/in/policy/new.txt", 4), ("/in/misc/n.txt", 4)],
        "path string, size long",
    )
    targets = remote.with_target(files, "/in")
    compared = {r.path: r for r in remote.compare_with_remote(targets, listing(spark)).collect()}
    assert [(compared[p].found, compared[p].is_duplicate, compared[p].remote_etag) for p in sorted(compared)] == [
        (True, False, "e2"),
        (True, True, "e1"),
        (False, False, None),
        (False, False, None),
    ]
    plan = {r.path: (r.action, r.message) for r in remote.transfer_plan(targets, listing(spark)).collect()}
    assert plan == {
        "/in/mba/same.csv": ("skip", "Skipped - already in S3: mba/csv/same.csv"),
        "/in/mba/other.csv": ("fail", "Exists with different size (use overwrite to replace)"),
        "/in/policy/new.txt": ("upload", "Uploaded to s3://policy-bucket/policy/text/new.txt"),
        "/in/misc/n.txt": ("fail", "Could not determine scope for file"),
    }
    over = {r.path: r.action for r in remote.transfer_plan(targets, listing(spark), overwrite=True).collect()}
    assert sorted(over.values()) == ["fail", "upload", "upload", "upload"]
    dry = {r.path: r.message for r in remote.transfer_plan(targets, listing(spark), dry_run=True).collect()}
    assert dry["/in/mba/same.csv"] == "s3://mba-bucket/mba/csv/same.csv"
    fixed = remote.with_target(files, "/in", "nowhere", auto_scope=False)
    assert {r.message for r in remote.transfer_plan(fixed, listing(spark)).collect()} == {"Invalid scope: nowhere"}


def test_similar_objects(spark, rows):
    files = spark.createDataFrame([("/in/Same.csv", 4), ("/in/none.csv", 77)], "path string, size long")
    got = rows(remote.similar_counts(files, listing(spark)))
    assert got == [("/in/Same.csv", 3, 1, "mba/csv/same.csv"), ("/in/none.csv", 0, 0, None)]
    one = files.where("size = 4")
    similar = rows(remote.similar_to(one, listing(spark)).distinct(), "key", "similarity")
    assert similar == [
        ("mba/csv/same.csv", "same_name"),
        ("old/SAME.CSV", "same_name"),
        ("policy/text/sized.txt", "same_size"),
    ]


def test_listing_forms(spark, tmp_path, rows):
    view = {r.key: r for r in remote.listing_view(listing(spark)).collect()}
    assert (view["old/SAME.CSV"].name, view["old/SAME.CSV"].type, view["old/SAME.CSV"].etag) == ("SAME.CSV", ".csv", "e3")
    totals = remote.listing_totals(listing(spark)).first()
    assert (totals.files, totals.types) == (5, 2)
    some = file_source.list_objects(listing(spark), "mba-bucket", "mba/", max_files=2)
    assert [r.key for r in some.collect()] == ["mba/csv/other.csv", "mba/csv/same.csv"]
    make(tmp_path, {"b1/k/a.csv": b"x", "b2/b.csv": b"yy"})
    store = rows(file_source.store_listing(spark, str(tmp_path)), "bucket", "key", "size")
    assert store == [("b1", "k/a.csv", 1), ("b2", "b.csv", 2)]


def test_directory_to_plan(spark, tmp_path):
    make(tmp_path, {"mba/same.csv": b"four", "mba/new.csv": b"1", "x/other.csv": b"9"})
    plan = transfer.plan_directory(spark, str(tmp_path), listing(spark), scope=None)
    stats = transfer.plan_stats(plan, str(tmp_path)).first()
    assert (stats.total, stats.uploaded, stats.skipped, stats.failed) == (3, 1, 1, 1)
    assert stats.success_rate == pytest.approx(200 / 3)
    default = transfer.plan_directory(spark, str(tmp_path), listing(spark), scope="policy")
    assert {r.key for r in default.collect()} == {"mba/csv/same.csv", "mba/csv/new.csv", "policy/csv/other.csv"}
    found = transfer.local_duplicates(spark, str(tmp_path), str(tmp_path / "state"))
    assert found.isEmpty()


def test_csv_edges(spark, tmp_path, rows):
    text = b'\xef\xbb\xbfId,Long Name,Z\n1,"a ""q"", b",x\n\n2\n3,"two\nlines",y,surplus\n4, \xff pad ,\n'
    path = tmp_path / "e.csv"
    path.write_bytes(text)
    df = csv_files.read_text_columns(spark, str(path), ["Id", "Long Name", "Z"])
    assert rows(df, "id", "long_name", "z") == [
        ("1", 'a "q", b', "x"),
        ("2", None, None),
        ("3", "two\nlines", "y"),
        ("4", "pad", None),
    ]
    assert {r["_file"] for r in df.collect()} == {str(path)}
    cells = csv_files.all_cells(spark, [str(path)], ["Id", "Long Name", "Z"])
    from ledgerline.operators.profile import profile_columns

    whole = {r.ordinal: r.nullable for r in profile_columns(cells).collect()}
    files = spark.createDataFrame([(str(path), ",")], "path string, delimiter string")
    sampled = {r.ordinal: r.nullable for r in profile_columns(csv_files.sample_cells(files).drop("error")).collect()}
    assert whole == sampled == {0: False, 1: False, 2: True}


def test_sample_limit(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a\n" + "1\n" * 3 + "\n\n" + "2\n3\n")
    files = spark.createDataFrame([(str(path), ",")], "path string, delimiter string")

    def values(limit):
        return [r.value for r in csv_files.sample_cells(files, limit).where("value IS NOT NULL").collect()]

    assert values(2) == ["1", "1"]
    # Blank records count but do not end the sample.
    assert values(4) == ["1", "1", "1", "2"]
    assert values(500) == ["1", "1", "1", "2", "3"]


def test_preview_and_report(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n" + "1,x\n" * 250)
    (tmp_path / "p.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "My Table.csv").write_text("First Name;Age\nann;5\nbob;\n")
    (tmp_path / "bad.csv").write_text("")
    gone = spark.createDataFrame([(str(tmp_path / "gone.csv"),)], "path string")
    count, head = csv_files.preview(spark, str(tmp_path / "p.csv"))
    assert (count, head.count()) == (250, 200)
    count, head = csv_files.preview(spark, str(tmp_path / "p.json"))
    assert (count, head.columns) == (2, ["a"])
    files = file_source.discover_files(spark, str(tmp_path), include={"csv"})
    report = {r.path.rsplit("/", 1)[-1]: r for r in csv_files.schema_report(files.select("path").union(gone)).collect()}
    assert set(report) == {"p.csv", "My Table.csv", "bad.csv", "gone.csv"}
    assert "gone.csv" in report["gone.csv"].error and report["gone.csv"].delimiter is None
    assert "no header" in report["bad.csv"].error and report["bad.csv"].records is None
    assert report["p.csv"].records == 250 and report["My Table.csv"].records == 2
    mine = report["My Table.csv"]
    assert mine.delimiter == ";" and [(c.name, c.snake, c.nullable) for c in mine.columns] == [
        ("First Name", "first_name", False),
        ("Age", "age", True),
    ]
    assert mine.ddl.startswith("CREATE TABLE IF NOT EXISTS `my table` (\n  `first_name` VARCHAR(3) NOT NULL,")
    counts = csv_files.record_counts(spark, [str(tmp_path / "p.csv"), str(tmp_path / "My Table.csv")])
    assert {r.path.rsplit("/", 1)[-1]: r.records for r in counts.collect()} == {"p.csv": 250, "My Table.csv": 2}


def test_copies_of_several_files_of_one_group(spark, rows):
    when = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame(
        [(p, 1, when, h) for p, h in (("/a", "x"), ("/b", "x"), ("/c", "x"), ("/d", "y"), ("/e", "y"), ("/f", "z"), ("/g", ""))],
        "path string, size long, modified timestamp_ntz, hash string",
    )
    targets = spark.createDataFrame([("/a",), ("/b",), ("/b",), ("/d",), ("/f",), ("/g",), ("/none",)], "target_path string")
    found = rows(duplicates.partners_of(files, targets), "target_path", "path")
    assert found == [("/a", "/b"), ("/a", "/c"), ("/b", "/a"), ("/b", "/c"), ("/d", "/e")]
