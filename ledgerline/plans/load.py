"""CSV files to tables, with an audit trail.

One call loads a batch of files. Paths and headers pass through the driver, as
the reader needs them there; contents, counts and errors never do. Directories
of any size are loaded batch by batch by the streaming form.

Each file is parsed once, into a staged table of text values. Types, faults and
counts come from there, and so do the rows that are published: they are written
into a folder of the run inside each table and become visible together, when
the folder is added to the table as a partition.

Tables and audit events are partitioned by the run that wrote them: the name of
its batch and a digest of its files. A run that is repeated, after a lost driver
or by a stream that restarts, replaces its own partition, so each file is loaded
once. Runs that want one content wait for each other (`leases`); others go on
side by side. A run that was lost before its files were recorded as loaded
leaves rows that no audit record tells of; the next load of any of those files
drops what that run wrote, but never what a run at work writes.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import names, value_types
from ledgerline.operators import audit, notices, profile
from ledgerline.plans import leases
from ledgerline.session import checkpoint_root, checkpointed
from ledgerline.sources import csv_files, tables
from ledgerline.sources import files as file_source
from ledgerline.sources import notices as notice_source

BATCH = "load_batch"
# How the partitions of compacted audit events are named.
ARCHIVE = "archive-"
MOST_ARCHIVES = 8
# Tables that one load publishes side by side.
SIDE_BY_SIDE = 4

# Parts of a file name and the table they route to, tested in
# this order.
ROUTES = (
    ("memberdata", "memberdata"),
    ("plan_details", "plan_details"),
    ("plandetails", "plan_details"),
    ("deductibles_oop", "deductibles_oop"),
    ("deductibles", "deductibles_oop"),
    ("benefit_accumulator", "benefit_accumulator"),
    ("accumulator", "benefit_accumulator"),
)


@dataclass(frozen=True)
class LoadSettings:
    """Where and how files are loaded.

    The schema of a new table comes from the whole of its first file, or, with
    ``sample_rows``, from so many of its first records. ``routed`` names tables by `ROUTES` instead of the file's name.
    ``row_hook`` sees the text columns of each table before they are typed.
    ``append_always`` also loads content that a table already has. A run that
    has not renewed its lease for ``lease_seconds`` counts as lost. The audit
    events of ended runs are put together when they have more than
    ``compact_after`` partitions.
    """

    database: str = "default"
    audit_table: str = "ingestion_audit_events"
    sample_rows: int | None = None
    multi_line: bool = True
    routed: bool = False
    append_always: bool = False
    lease_seconds: float = leases.SECONDS
    compact_after: int = 500
    row_hook: Callable[[DataFrame], DataFrame] | None = None

    def table(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"


@dataclass
class _Part:
    """Files of one batch that go to one table with one header."""

    delimiter: str
    headers: list[str]
    paths: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [names.snake_name(h) for h in self.headers]

    def of(self, paths: list[str]) -> _Part:
        return _Part(self.delimiter, self.headers, paths)


def _own_name(header: str) -> str:
    """A header whose column would take the name of the batch column gives way."""
    return f"{header}_csv" if names.snake_name(header) == BATCH else header


def route(key: Column | str) -> Column:
    """The table a file name routes to, NULL for none."""
    name = F.lower(names.base_name(key))
    return F.coalesce(*[F.when(name.contains(part), F.lit(table)) for part, table in ROUTES])


def with_route(files: DataFrame) -> DataFrame:
    """Add ``table_name`` by routing, and the ``error`` of files without one."""
    is_csv = F.lower("key").endswith(".csv")
    where = F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key")
    error = F.when(~is_csv, F.concat(F.lit("Not a CSV key: "), where)).when(
        route("key").isNull(), F.concat(F.lit("Cannot route ETL for key: "), "key")
    )
    return files.withColumn("table_name", F.when(is_csv, route("key"))).withColumn("error", error)


def audit_events(spark: SparkSession, settings: LoadSettings) -> DataFrame:
    """All audit events so far; none before the first load."""
    table = settings.table(settings.audit_table)
    fields = [f.strip().split(" ")[0] for f in audit.EVENT_SCHEMA.split(",")]
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], audit.EVENT_SCHEMA)
    return spark.table(table).select(*fields)


def _append_events(events: DataFrame, settings: LoadSettings, batch: str) -> None:
    """Publish audit events as a partition of their run and kind."""
    spark = events.sparkSession
    table = settings.table(settings.audit_table)
    rest = [f.strip() for f in audit.EVENT_SCHEMA.split(",") if f.strip() != "event string"]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(rest)}, {BATCH} string, event string) "
        f"USING parquet PARTITIONED BY ({BATCH}, event)"
    )
    events = checkpointed(events)
    for kind in sorted(r.event for r in events.select("event").distinct().collect()):
        rows = events.where(F.col("event") == kind).select(*[r.split(" ")[0] for r in rest])
        _publish(rows, table, {BATCH: batch, "event": kind})


def compact_audit(spark: SparkSession, settings: LoadSettings) -> None:
    """Put the audit events of all ended runs into one partition a kind, an
    archive; earlier archives join it when there are ``MOST_ARCHIVES``, so that
    an event is not written anew each time.

    Runs at work and lost ones keep their partitions. The new partitions are
    there before the old ones go, so a reader may meet an event twice, which
    changes no state: events are folded by their id.
    """
    table = settings.table(settings.audit_table)
    events = spark.table(table)
    ended = checkpointed(events.where("event <> 'STARTED'").select(BATCH).distinct())
    archived = F.col(BATCH).startswith(ARCHIVE)
    if ended.where(archived).count() < MOST_ARCHIVES:
        ended = ended.where(~archived)
    old = [(r[BATCH], r.event) for r in events.join(ended, BATCH, "left_semi").select(BATCH, "event").distinct().collect()]
    name = f"{ARCHIVE}{uuid.uuid4().hex}"
    for kind in sorted({event for _, event in old}):
        rows = events.where(F.col("event") == kind).join(ended, BATCH, "left_semi").drop(BATCH, "event")
        # Records of one content lie together, so that a load reads few row groups.
        _publish(rows.repartitionByRange("table_name", "content_md5"), table, {BATCH: name, "event": kind})
    for batch, kind in old:
        _withdraw(spark, table, {BATCH: batch, "event": kind})


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _location(spark: SparkSession, table: str, part: dict[str, str]) -> str:
    """The folder of a partition, named by a digest of its values."""
    about = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
    inside = "/".join(hashlib.md5(f"{k}={v}".encode()).hexdigest() for k, v in part.items())
    return f"{about['data_type'].rstrip('/')}/{inside}"


def _publish(rows: DataFrame, table: str, part: dict[str, str]) -> None:
    """Replace a partition: its rows are written to a folder of its own, which
    is then added to the table, so that readers see all of them or none, and
    writers of other partitions do not meet."""
    spark = rows.sparkSession
    where = _location(spark, table, part)
    values = ", ".join(f"`{k}` = {_quoted(v)}" for k, v in part.items())
    rows.write.mode("overwrite").parquet(where)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({values}) LOCATION {_quoted(where)}")
    spark.catalog.refreshTable(table)


def _withdraw(spark: SparkSession, table: str, part: dict[str, str]) -> None:
    """Drop a partition and its folder, whether it was added or not."""
    where = _location(spark, table, part)
    values = ", ".join(f"`{k}` = {_quoted(v)}" for k, v in part.items())
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({values})")
    leases.remove_folder(spark, where)


def _audit_id(batch: str) -> Column:
    """An id in UUID form that a repeated batch gives again."""
    digest = F.md5(F.concat_ws("|", F.lit(batch), "bucket", "key", "md5"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def _not_loaded(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Files whose content their table does not have yet; of equal files in
    one batch, the first by path. Of the audit trail only the records of these
    contents are folded."""
    content = manifest.select("table_name", F.col("md5").alias("content_md5")).distinct()
    begun = events.where("event = 'STARTED'").join(content, ["table_name", "content_md5"], "left_semi")
    known = events.join(begun.select("id").distinct(), "id", "left_semi")
    done = audit.audit_state(known).where("status = 'SUCCESS'").select("table_name", F.col("content_md5").alias("md5"))
    first = manifest.groupBy("table_name", "md5").agg(F.min("path").alias("path"))
    fresh = manifest.join(first, ["table_name", "md5", "path"], "left_semi")
    return fresh.join(done.distinct(), ["table_name", "md5"], "left_anti")


def _drop_lost_runs(loads: DataFrame, settings: LoadSettings) -> None:
    """Drop what runs wrote that began to load one of these contents and never
    recorded an outcome. None of their files counts as loaded, and none of them
    is at work: this run has waited for those that are."""
    spark = loads.sparkSession
    trail = settings.table(settings.audit_table)
    if not spark.catalog.tableExists(trail):
        return
    events = spark.table(trail)
    content = loads.select("table_name", F.col("md5").alias("content_md5")).distinct()
    begun = events.where("event = 'STARTED'")
    runs = begun.join(content, ["table_name", "content_md5"], "left_semi").select(BATCH).distinct()
    ended = events.where("event <> 'STARTED'").select(BATCH).distinct()
    lost = runs.join(ended, BATCH, "left_anti")
    for r in begun.join(lost, BATCH, "left_semi").select(BATCH, "table_name").distinct().toLocalIterator():
        full = settings.table(r.table_name)
        if spark.catalog.tableExists(full):
            _withdraw(spark, full, {BATCH: r[BATCH]})


def load_files(files: DataFrame, settings: LoadSettings, batch: str) -> DataFrame:
    """Load files (path, bucket, key) and return one result row per file, with
    status success, failed, or skipped for content loaded before.

    ``batch`` names the batch; running it again with the same files repeats
    nothing. Each file succeeds or fails as a whole, and one that fails stops
    no other.
    """
    spark = files.sparkSession
    tables.create_database(spark, settings.database)
    named = with_route(files) if settings.routed else files.select("*", names.table_name("key").alias("table_name"))
    named = named if settings.routed else named.withColumn("error", F.lit(None).cast("string"))
    hashed = file_source.hash_files(
        file_source.dealt(named.select("path", "bucket", "key", "table_name", "error"))
    ).withColumnRenamed("hash", "md5")
    sizes = file_sizes(hashed)
    manifest = checkpointed(sizes.withColumn("id", _audit_id(batch)).withColumn("request_id", F.lit(None).cast("string")))

    # Unreadable or unroutable files fail before an audit record exists.
    accepted = manifest.where("error IS NULL AND md5 <> ''")
    folder = leases.Folder(spark, f"{_database_folder(spark, settings)}/_load_runs")
    with leases.Lease(folder, settings.lease_seconds) as lease:
        lease.claim(accepted.select("table_name", "md5").distinct())
        if settings.append_always:
            loads = accepted
        else:
            loads = checkpointed(_not_loaded(accepted, audit_events(spark, settings)))
        files_digest = F.hex(F.bit_xor(F.xxhash64("path", "md5")))
        run = f"{batch}-{loads.agg(files_digest).first()[0] or 0}"
        _drop_lost_runs(loads, settings)
        _append_events(audit.started(loads, F.current_timestamp().cast("timestamp_ntz")), settings, run)

        delimited = checkpointed(csv_files.with_delimiter(loads.select("path", "table_name")))
        # Without a given number of records the cells name the columns only.
        cells = checkpointed(csv_files.sample_cells(delimited, settings.sample_rows or 1))
        parts, refused = _parts(delimited, cells)
        outcome = _load_parts(spark, settings, parts, cells, run, lease)
        unread = cells.where("error IS NOT NULL").select(F.col("file").alias("path"), "error")
        unread = unread.union(spark.createDataFrame(list(refused.items()), "path string, error string"))
        unread = unread.groupBy("path").agg(F.min("error").alias("error_message"))
        outcome = checkpointed(
            outcome.unionByName(
                unread.withColumns({"rows_inserted": F.lit(None).cast("long"), "duration_ms": F.lit(0)}),
            )
        )
        # The files of a table are loaded together: each has the time of its table.
        done = loads.join(outcome, "path").withColumn("retry_count", F.lit(0))
        now = F.current_timestamp().cast("timestamp_ntz")
        finished = audit.succeeded(done.where("error_message IS NULL"), now).unionByName(
            audit.failed(done.where("error_message IS NOT NULL"), now)
        )
        _append_events(finished, settings, run)
        if spark.sql(f"SHOW PARTITIONS {settings.table(settings.audit_table)}").count() > settings.compact_after:
            compact_audit(spark, settings)
    return _results(manifest, delimited, outcome)


def _database_folder(spark: SparkSession, settings: LoadSettings) -> str:
    return spark.catalog.getDatabase(settings.database).locationUri.rstrip("/")


_STAGED = "file string, values array<string>, part int"


def _load_parts(
    spark: SparkSession,
    settings: LoadSettings,
    parts: dict[str, list[_Part]],
    cells: DataFrame,
    run: str,
    lease: leases.Lease,
) -> DataFrame:
    """Stage, check and publish the files of all tables. ``path``,
    ``rows_inserted``, ``error_message`` and ``duration_ms`` of each file."""
    began = time.monotonic()
    numbered = {n: (table, part) for n, (table, part) in enumerate((t, p) for t, some in parts.items() for p in some)}
    files = [(path, plain(path), table, n) for n, (table, part) in numbered.items() for path in part.paths]
    stage = _Stage(spark, settings, f"{checkpoint_root(spark)}/load-{uuid.uuid4().hex}")
    refused: dict[int, str] = {}
    # The first file of a new table says what its columns are.
    new = [t for t in parts if not spark.catalog.tableExists(settings.table(t))]
    firsts = {}
    for table in new:
        n = min((n for n, (t, _) in numbered.items() if t == table), key=lambda n: numbered[n][1].paths[0])
        firsts[n] = numbered[n][1].of(numbered[n][1].paths[:1])
    stage.read(firsts)
    for table in parts:
        first = next((n for n in firsts if numbered[n][0] == table), None)
        sample = stage.values_of(first, firsts[first].paths[0]) if first is not None else None
        try:
            _ensure_table(spark, settings, table, parts[table], cells, sample)
        except (PySparkException, ValueError) as e:
            refused.update({n: f"{type(e).__name__}: {e}" for n, (t, _) in numbered.items() if t == table})
    rest = {n: p.of([f for f in p.paths if n not in firsts or f not in firsts[n].paths]) for n, (_, p) in numbered.items()}
    stage.read({n: p for n, p in rest.items() if p.paths and n not in refused})

    columns = {t: _columns(spark, settings.table(t)) for t in parts if spark.catalog.tableExists(settings.table(t))}
    checked = []
    for n, (table, part) in numbered.items():
        if n in refused:
            continue
        try:
            fault = _unfit(stage.rows(n, part), columns[table])
            if fault:
                refused[n] = fault
            else:
                checked.append(_faults(stage.rows(n, part), columns[table]))
        except (PySparkException, ValueError) as e:
            refused[n] = f"{type(e).__name__}: {e}"
    none = spark.createDataFrame([], "plain string, rows long, fault string")
    found = reduce(DataFrame.unionByName, checked, none)
    listed = spark.createDataFrame(
        [(p, q, t, n, stage.errors.get(p) or refused.get(n)) for p, q, t, n in files],
        "path string, plain string, table_name string, part int, error string",
    )
    # A file with a header only has no row of its own.
    state = checkpointed(
        listed.join(found, "plain", "left").select(
            "path",
            "plain",
            "table_name",
            "part",
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("error", "fault").alias("error"),
        )
    )
    good = state.where("error IS NULL")
    full = {r.table_name for r in good.select("table_name").distinct().collect()}

    def publish(table: str) -> tuple[str, str | None, int]:
        try:
            own = [(n, p) for n, (t, p) in numbered.items() if t == table and n not in refused]
            typed = [_typed(stage.rows(n, p), columns[table]) for n, p in own]
            rows = reduce(DataFrame.unionByName, typed)
            rows = rows.join(good.select(F.col("plain").alias("_file")), "_file", "left_semi").drop("_file")
            lease.check()
            _publish(rows, settings.table(table), {BATCH: run})
            if not lease.held():  # another run may have swept this one while it wrote
                _withdraw(spark, settings.table(table), {BATCH: run})
                lease.check()
        except (PySparkException, ValueError) as e:
            return table, f"{type(e).__name__}: {e}", int((time.monotonic() - began) * 1000)
        return table, None, int((time.monotonic() - began) * 1000)

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        written = list(pool.map(publish, sorted(full)))
    tables_ = spark.createDataFrame(written, "table_name string, table_error string, took int")
    result = state.join(tables_, "table_name", "left")
    error = F.coalesce("error", "table_error")
    spent = int((time.monotonic() - began) * 1000)
    return result.select(
        "path",
        F.when(error.isNull(), F.col("rows")).alias("rows_inserted"),
        error.alias("error_message"),
        F.coalesce("took", F.lit(spent)).alias("duration_ms"),
    )


class _Stage:
    """The text values of files, parsed once each."""

    def __init__(self, spark: SparkSession, settings: LoadSettings, folder: str):
        self.spark, self.settings, self.folder = spark, settings, folder
        self.written: list[str] = []
        self.errors: dict[str, str] = {}

    def read(self, parts: dict[int, _Part]) -> None:
        """Stage the files of ``parts`` in one job. Where that breaks, parts are
        read one by one, then files, and only those that break fail."""
        if not parts:
            return
        where = f"{self.folder}/{len(self.written)}-{uuid.uuid4().hex}"
        try:
            rows = [
                csv_files.read_values(self.spark, p.paths, p.headers, p.delimiter, self.settings.multi_line).select(
                    "file", "values", F.lit(n).alias("part")
                )
                for n, p in parts.items()
            ]
            reduce(DataFrame.unionByName, rows).write.partitionBy("part").parquet(where)
        except PySparkException as e:
            alone = [(n, p.of([path])) for n, p in parts.items() for path in p.paths]
            if len(alone) == 1:
                self.errors[alone[0][1].paths[0]] = f"{type(e).__name__}: {e}"
                return
            for n, p in parts.items() if len(parts) > 1 else alone:
                self.read({n: p})
            return
        self.written.append(where)

    def values_of(self, n: int, path: str) -> DataFrame:
        """The records of one file."""
        return self.values().where((F.col("part") == n) & (F.col("file") == plain(path)))

    def rows(self, n: int, part: _Part) -> DataFrame:
        """The text columns of a part, blanks as NULL, and ``_file``."""
        rows = self.values().where(F.col("part") == n)
        blank = [F.nullif(F.get("values", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(part.columns)]
        rows = rows.select(*blank, F.col("file").alias("_file"))
        return self.settings.row_hook(rows) if self.settings.row_hook else rows

    def values(self) -> DataFrame:
        if not self.written:
            return self.spark.createDataFrame([], _STAGED)
        read = [self.spark.read.schema(_STAGED).parquet(w) for w in self.written]
        return reduce(DataFrame.unionByName, read)


def file_sizes(files: DataFrame) -> DataFrame:
    """Add the ``bytes`` of each file, -1 where there is no such file."""

    def size(path: str) -> int:
        system, inside = file_source.open_path(path)
        found = system.get_file_info(inside).size
        return -1 if found is None else found

    @F.pandas_udf("long")
    def sizes(paths: pd.Series) -> pd.Series:
        return paths.map(size).astype("int64")

    return files.withColumn("bytes", sizes(F.col("path")))


def _results(manifest: DataFrame, delimited: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per file of the batch."""
    known = manifest.join(outcome, "path", "left").join(delimited.select("path", "delimiter"), "path", "left")
    reject = F.coalesce("error", F.when(F.col("md5") == "", F.lit("FileNotFoundError: cannot read file")))
    error = F.coalesce(reject, "error_message")
    status = (
        F.when(error.isNotNull(), F.lit("failed"))
        .when(F.col("rows_inserted").isNotNull(), F.lit("success"))
        .otherwise(F.lit("skipped"))
    )
    return known.select(
        "path",
        "bucket",
        "key",
        "table_name",
        "delimiter",
        "rows_inserted",
        F.when(reject.isNull() & (status != "skipped"), F.col("id")).alias("audit_id"),
        status.alias("status"),
        error.alias("error_message"),
    )


def _parts(delimited: DataFrame, cells: DataFrame) -> tuple[dict[str, list[_Part]], dict[str, str]]:
    """The files of each table, grouped by delimiter and header, and what is
    wrong with the header of each other file."""
    header = (
        cells.where("error IS NULL AND value IS NULL")
        .groupBy(F.col("file").alias("path"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("header"))
        .select("path", F.transform("header", lambda h: h["name"]).alias("header"))
    )
    parts: dict[tuple, _Part] = {}
    by_table: dict[str, list[_Part]] = defaultdict(list)
    refused: dict[str, str] = {}
    for r in delimited.join(header, "path").orderBy("path").toLocalIterator():
        key = (r.table_name, r.delimiter, tuple(map(_own_name, r.header)))
        if key not in parts:
            try:
                names.snake_headers(list(key[2]))
            except ValueError as e:
                refused[r.path] = f"{type(e).__name__}: {e}"
                continue
            parts[key] = _Part(r.delimiter, list(key[2]))
            by_table[r.table_name].append(parts[key])
        parts[key].paths.append(r.path)
    return by_table, refused


def _ensure_table(
    spark: SparkSession, settings: LoadSettings, table: str, parts: list[_Part], cells: DataFrame, values: DataFrame | None
) -> None:
    """Create the table from its first file, unless it exists; ``values`` has
    the staged values of that file."""
    full = settings.table(table)
    if spark.catalog.tableExists(full):
        return
    first = min(parts, key=lambda p: p.paths[0])
    path = first.paths[0]
    if settings.sample_rows is None:
        columns = [F.get("values", F.lit(k)).alias(f"c{k}") for k in range(len(first.headers))]
        found = profile.profile_rows(values.select(*columns), path, first.headers)
    else:
        found = profile.profile_columns(cells.where(F.col("file") == path).drop("error"))
    typed = profile.with_types(found)
    columns = typed.select("ordinal", "snake", value_types.spark_type(F.col("column_type")).alias("type"), "nullable")
    # File tables do not keep NOT NULL, so it is kept as a comment.
    lines = [
        f"`{_own_name(c.snake)}` {c.type}" + ("" if c.nullable else " COMMENT 'NOT NULL'")
        for c in sorted(columns.toLocalIterator(), key=lambda c: c.ordinal)
    ]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {full} ({', '.join(lines)}, `{BATCH}` string) "
        f"USING parquet PARTITIONED BY (`{BATCH}`)"
    )


def _columns(spark: SparkSession, full: str) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of a table's own columns."""
    listed = tables.describe(spark, full)
    return [(name, kind, comment != "NOT NULL") for name, kind, comment in listed if name != BATCH]


def _unfit(rows: DataFrame, columns: list[tuple[str, str, bool]]) -> str | None:
    """Why no row of a part can fit the table, from the column names."""
    present = [c for c in rows.columns if c != "_file"]
    unknown = [c for c in present if c not in {n for n, _, _ in columns}]
    absent = [n for n, _, nullable in columns if n not in present and not nullable]
    if unknown:
        return f"Unknown column '{unknown[0]}'"
    if absent:
        return f"Field '{absent[0]}' has no default value"
    return None


def _faults(rows: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """``rows`` and first ``fault`` of each file (``plain``) of a part."""
    faults = []
    for name, kind, nullable in columns:
        if name not in rows.columns:
            continue
        value = F.col(f"`{name}`")
        if not nullable:
            faults.append(F.when(value.isNull(), F.lit(f"Column '{name}' cannot be null")))
        unfit = value.isNotNull() & value_types.typed(value, kind).isNull()
        faults.append(F.when(unfit, F.concat(F.lit(f"Incorrect {kind} value for column '{name}': "), F.left(value, F.lit(100)))))
    fault = F.coalesce(*faults) if faults else F.lit(None).cast("string")
    return rows.groupBy(F.col("_file").alias("plain")).agg(F.count("*").alias("rows"), F.min(fault).alias("fault"))


def _typed(rows: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """The rows as the table has them, and ``_file``."""
    values = [
        (value_types.typed(F.col(f"`{n}`"), kind) if n in rows.columns else F.lit(None)).cast(_storage(kind)).alias(n)
        for n, kind, _ in columns
    ]
    return rows.select(*values, "_file")


def plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def _storage(kind: str) -> str:
    return "string" if kind.lower().startswith(("varchar", "char")) else kind


def load_notices(
    notice_rows: DataFrame, store_root: str, settings: LoadSettings, batch: str
) -> tuple[DataFrame, DataFrame]:
    """Load what object-created notices (request_id, body) name, from
    ``store_root/<bucket>/<key>``: results per record, summary per request."""
    records = checkpointed(notices.select_records(notice_source.parse_notices(notice_rows)))
    path = F.concat_ws("/", F.lit(store_root.rstrip("/")), "bucket", "key")
    wanted = records.where("status = 'load'").select(path.alias("path"), "bucket", "key").distinct()
    loaded = load_files(wanted, settings, batch).select(
        "bucket",
        "key",
        "table_name",
        "delimiter",
        F.coalesce("rows_inserted", F.lit(0)).alias("rows_inserted"),
        "audit_id",
        F.when(F.col("status") == "failed", F.lit("failed")).otherwise(F.lit("success")).alias("loaded"),
        "error_message",
    )
    results = records.join(loaded, ["bucket", "key"], "left").select(
        "request_id",
        "record_index",
        "bucket",
        "key",
        "table_name",
        "rows_inserted",
        "delimiter",
        "audit_id",
        F.coalesce("loaded", "status").alias("status"),
        F.coalesce("reason", "error_message").alias("reason"),
    )
    return results, notices.run_summary(results)
