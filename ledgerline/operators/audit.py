"""The audit trail: events are appended, the state of a load is derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.spread import lookup_join

# The columns of an audit event.
EVENT_SCHEMA = (
    "id string, event string, ts timestamp_ntz, s3_bucket string, s3_key string, "
    "table_name string, content_md5 string, bytes bigint, duration_ms int, "
    "rows_inserted bigint, error_message string, lambda_request_id string, retry_count int"
)

# Widths of the audit record's text fields.
BUCKET_WIDTH = 255
TABLE_WIDTH = 255
REQUEST_WIDTH = 64
ERROR_WIDTH = 4000
SNIPPET_WIDTH = 100
BROWSER_WIDTH = 180

# Later events of one time win in this order.
_RANK = {"STARTED": 0, "FAILED": 1, "SUCCESS": 2}

# What a STARTED event alone holds.
_BEGUN = ("s3_bucket", "s3_key", "table_name", "content_md5", "bytes", "lambda_request_id")


def _events(rows: DataFrame, event: str, **values: Column) -> DataFrame:
    """Rows as audit events; fields that are not given are NULL."""
    fields = [f.strip().split(" ") for f in EVENT_SCHEMA.split(",")]
    values = {"event": F.lit(event), **values}
    return rows.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def started(loads: DataFrame, ts: Column) -> DataFrame:
    """STARTED events of loads (id, bucket, key, table_name, md5, bytes and
    request_id). A missing field or a negative size is an error."""
    required = ["bucket", "key", "table_name", "md5"]
    missing = [F.coalesce(F.col(c), F.lit("")) == "" for c in required]
    bad = missing[0] | missing[1] | missing[2] | missing[3]
    checked = (
        F.when(bad, F.raise_error(F.lit("bucket, key, table and md5 are required")))
        .when(F.col("bytes") < 0, F.raise_error(F.lit("size cannot be negative")))
        .otherwise(F.col("id"))
    )
    return _events(
        loads,
        "STARTED",
        id=checked,
        ts=ts,
        s3_bucket=F.left("bucket", F.lit(BUCKET_WIDTH)),
        s3_key=F.col("key"),
        table_name=F.left("table_name", F.lit(TABLE_WIDTH)),
        content_md5=F.col("md5"),
        bytes=F.col("bytes"),
        lambda_request_id=F.left("request_id", F.lit(REQUEST_WIDTH)),
    )


def _with_id(rows: DataFrame) -> Column:
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit("audit id is required"))).otherwise(F.col("id"))


def succeeded(loads: DataFrame, ts: Column) -> DataFrame:
    """SUCCESS events of loads (id, rows_inserted, duration_ms)."""
    negative = (F.col("rows_inserted") < 0) | (F.col("duration_ms") < 0)
    rows = F.when(negative, F.raise_error(F.lit("rows and duration cannot be negative"))).otherwise(
        F.col("rows_inserted")
    )
    return _events(
        loads, "SUCCESS", id=_with_id(loads), ts=ts, rows_inserted=rows, duration_ms=F.col("duration_ms")
    )


def failed(loads: DataFrame, ts: Column) -> DataFrame:
    """FAILED events of loads (id, error_message, retry_count)."""
    error = F.coalesce(F.nullif("error_message", F.lit("")), F.lit("Unknown error"))
    return _events(
        loads,
        "FAILED",
        id=_with_id(loads),
        ts=ts,
        error_message=F.left(error, F.lit(ERROR_WIDTH)),
        retry_count=F.coalesce("retry_count", F.lit(0)),
    )


def audit_state(events: DataFrame) -> DataFrame:
    """The audit record of each id: the last event decides the status; times,
    rows and errors are those the last event of their kind wrote. Ids that
    never started have no record."""
    ranks = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    order = F.struct("ts", F.try_element_at(ranks, F.col("event")))
    kind = F.col("event")

    def written(event: str, *columns: str) -> Column:
        """What the last event of a kind wrote; times come first in the order."""
        return F.max(F.when(kind == event, F.struct("ts", *columns))).alias(event)

    begun = F.min(F.when(kind == "STARTED", F.struct("ts", *_BEGUN))).alias("begun")
    folded = events.groupBy("id").agg(
        begun,
        written("SUCCESS", "duration_ms", "rows_inserted"),
        written("FAILED", "retry_count", "error_message"),
        F.max_by("event", order).alias("status"),
    )
    return folded.where("begun IS NOT NULL").select(
        "id",
        *[F.col(f"begun.{c}").alias(c) for c in _BEGUN if c != "lambda_request_id"],
        F.col("begun.ts").alias("started_at"),
        F.greatest("SUCCESS.ts", "FAILED.ts").alias("finished_at"),
        F.col("SUCCESS.duration_ms").alias("duration_ms"),
        F.col("SUCCESS.rows_inserted").alias("rows_inserted"),
        "status",
        F.when(F.col("status") == "FAILED", F.col("FAILED.error_message")).alias("error_message"),
        F.col("begun.lambda_request_id").alias("lambda_request_id"),
        F.coalesce("FAILED.retry_count", F.lit(0)).alias("retry_count"),
    )


def iso_time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _newest(state: DataFrame, n: int) -> DataFrame:
    return state.orderBy(F.desc("started_at"), F.asc("id")).limit(n)


def recent_audits(state: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` loads, ties by id; long errors are cut."""
    error = F.col("error_message")
    cut = F.when(
        F.length(error) > SNIPPET_WIDTH, F.concat(F.left(error, F.lit(SNIPPET_WIDTH)), F.lit("..."))
    ).otherwise(error)
    return _newest(state, n).select(
        F.col("id").alias("audit_id"),
        "s3_key",
        "table_name",
        "status",
        iso_time("started_at").alias("started_at"),
        iso_time("finished_at").alias("finished_at"),
        "duration_ms",
        "rows_inserted",
        cut.alias("error_message"),
    )


def browse_audits(state: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` loads as the table browser shows them."""
    error = F.coalesce("error_message", F.lit(""))
    return _newest(state, n).select(
        F.col("id").alias("audit_id"),
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
        F.col("s3_key").alias("key"),
        "status",
        F.coalesce("rows_inserted", F.lit(0)).alias("rows_inserted"),
        F.left(error, F.lit(BROWSER_WIDTH)).alias("error"),
    )


def audit_lookup(requests: DataFrame, state: DataFrame) -> DataFrame:
    """The record of each requested ``audit_id``, or status ``not_found``."""
    record = state.select(
        F.col("id").alias("audit_id"),
        "s3_bucket",
        "s3_key",
        "table_name",
        "status",
        iso_time("started_at").alias("started_at"),
        iso_time("finished_at").alias("finished_at"),
        "duration_ms",
        "rows_inserted",
        "error_message",
        "retry_count",
    )
    found = lookup_join(requests, record, ["audit_id"], ["request_id"])
    return found.withColumn("status", F.coalesce("status", F.lit("not_found")))
