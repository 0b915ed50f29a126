"""Files that arrive over time: loading them, planning their transfer.

Spark's file streams pass over files named ``_x`` or ``.x``. Those are listed
when a stream starts and with each batch, and go along with it unless they have
been dealt with before, so none is lost; one that arrives after the last batch
is taken at the next start.
"""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions import names
from ledgerline.operators import notices, remote
from ledgerline.plans.load import LoadSettings, audit_events, load_files
from ledgerline.session import checkpoint_root, checkpointed
from ledgerline.sources.csv_files import plain_name
from ledgerline.sources.files import list_files, open_path, plain_path

# The batch of hidden files found at the start of a stream of plans.
HIDDEN_BATCH = "hidden-"
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, root: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files below ``root`` as a stream: path, size, modified. Contents
    are not read."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .options(recursiveFileLookup=True, pathGlobFilter=pattern, maxFilesPerTrigger=per_trigger)
        .load(root)
    )
    return stream.select(
        plain_path(F.col("path")).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
    )


def hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below ``root`` that a stream does not see: path, size, modified."""
    listed = list_files(spark, root).where(names.base_name("path").rlike("^[_.]"))
    return listed.withColumn("path", plain_path(F.col("path")))


def _below(root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.col("path").substr(F.lit(len(base) + 1), F.length("path"))


def _start(stream: DataFrame, each, checkpoint: str | None, name: str, every: str | None) -> StreamingQuery:
    """Start a stream; without a folder of its own its progress goes below the
    shared checkpoint folder, under a digest of its ``name``."""
    own = hashlib.md5(name.encode()).hexdigest()
    where = checkpoint or f"{checkpoint_root(stream.sparkSession)}/stream-{own}"
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", where)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_loads(
    spark: SparkSession,
    store_root: str,
    settings: LoadSettings,
    checkpoint: str | None = None,
    every: str | None = None,
    per_trigger: int = 1000,
) -> StreamingQuery:
    """Load CSV files as they arrive in ``store_root/<bucket>/<key>``: those
    present now and stop, or with ``every`` go on at that interval.

    Keys are tested as the notices of new objects are. A batch that a restart
    repeats has the same number and files, so they are loaded once.
    """
    rest = _below(plain_name(store_root))

    def wanted(files: DataFrame) -> DataFrame:
        objects = (
            files.withColumn("bucket", F.substring_index(rest, "/", 1))
            .withColumn("key", rest.substr(F.length("bucket") + 2, F.length("path")))
            .withColumn("record_index", F.lit(0))
        )
        return notices.select_records(objects).where("status = 'load'")

    def unseen() -> DataFrame:
        """Hidden files without an audit record since they were written."""
        begun = audit_events(spark, settings).where("event = 'STARTED'")
        begun = begun.groupBy(F.col("s3_bucket").alias("bucket"), F.col("s3_key").alias("key")).agg(F.max("ts").alias("ts"))
        files = wanted(hidden_files(spark, store_root)).join(begun, ["bucket", "key"], "left")
        return files.where("ts IS NULL OR ts < modified").select("path", "bucket", "key")

    def load(batch: DataFrame, number: int) -> None:
        # The result is the audit trail; the returned rows are not needed.
        load_files(batch.union(unseen()), settings, f"stream-{number}")

    before = checkpointed(unseen())
    if not before.isEmpty():
        load_files(before, settings, "hidden")
    arriving = wanted(arriving_files(spark, store_root, per_trigger=per_trigger)).select("path", "bucket", "key")
    return _start(arriving, load, checkpoint, f"loads {store_root} {settings.database}", every)


def stream_plans(
    spark: SparkSession,
    root: str,
    listing: DataFrame,
    target: str,
    checkpoint: str | None = None,
    every: str | None = None,
    per_trigger: int = 1000,
    **options: bool,
) -> StreamingQuery:
    """Plan the transfer of files as they arrive; each batch replaces its own
    partition of the parquet table at ``target``."""

    schema = remote.transfer_plan(remote.with_target(hidden_files(spark, root), root), listing, **options).schema

    def unseen() -> DataFrame:
        """Hidden files that no batch has planned yet."""
        system, inside = open_path(target)
        files = hidden_files(spark, root)
        if system.get_file_info(inside).type == arrow_fs.FileType.NotFound:
            return files
        planned = spark.read.schema(schema).parquet(target).select("path").distinct()
        return files.join(planned, "path", "left_anti")

    def plan(batch: DataFrame, number: int | str) -> None:
        files = checkpointed(batch.union(unseen()))
        rows = remote.transfer_plan(remote.with_target(files, root), listing, **options)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = checkpointed(unseen())
    if not before.isEmpty():
        plan(before.limit(0), f"{HIDDEN_BATCH}{uuid.uuid4().hex}")
    return _start(arriving_files(spark, root, per_trigger=per_trigger), plan, checkpoint, f"plans {root} {target}", every)
