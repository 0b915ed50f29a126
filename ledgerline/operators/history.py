"""Upload history: records, batch figures, totals, trends; job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names


def upload_records(results: DataFrame, root: str) -> DataFrame:
    """History rows from upload results (path, success, message, size, ts).

    A success whose message has "Skipped" is ``skipped``; the key is the text
    after the last ``s3://`` of the message, "" without one.
    """
    status = (
        F.when(~F.col("success"), F.lit("failed"))
        .when(F.col("message").contains("Skipped"), F.lit("skipped"))
        .otherwise(F.lit("success"))
    )
    key = F.when(F.col("message").contains("s3://"), F.substring_index("message", "s3://", -1))
    return results.select(
        F.col("path").alias("file_path"),
        F.coalesce(names.scope_of("path", root), F.lit("unknown")).alias("scope"),
        F.coalesce(key, F.lit("")).alias("s3_key"),
        status.alias("status"),
        "message",
        F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"),
        F.col("ts").alias("timestamp"),
    )


def _is(status: str) -> Column:
    return F.col("status") == status


def batch_stats(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files uploaded, skipped and failed, per batch when ``by`` is given; the
    success rate counts skips as successes and is NULL for no files."""
    uploaded, skipped = F.count_if(_is("success")), F.count_if(_is("skipped"))
    total = F.count("*")
    return history.groupBy(*(by or [])).agg(
        total.alias("total"),
        uploaded.alias("uploaded"),
        skipped.alias("skipped"),
        F.count_if(_is("failed")).alias("failed"),
        F.try_divide((uploaded + skipped) * F.lit(100.0), total).alias("success_rate"),
    )


def running_totals(history: DataFrame) -> DataFrame:
    """Totals over all batches; only successful uploads add to the size."""
    size = F.coalesce(F.sum(F.when(_is("success"), F.col("size"))), F.lit(0))
    return history.agg(
        F.count_if(_is("success")).alias("total_uploaded"),
        F.count_if(_is("skipped")).alias("total_skipped"),
        F.count_if(_is("failed")).alias("total_failed"),
        size.alias("total_size"),
        names.megabytes(size).alias("total_mb"),
    )


def _in_range(history: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """History of the days ``start`` to ``end``; the test is on the bare
    timestamp so that it reaches the scan."""
    if start:
        history = history.where(F.col("timestamp") >= F.lit(start).cast("date"))
    if end:
        history = history.where(F.col("timestamp") < F.date_add(F.lit(end).cast("date"), 1))
    return history


def daily_trend(history: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    day = F.to_date("timestamp").alias("date")
    return _in_range(history, start, end).groupBy(day, "status").agg(F.count("*").alias("count"))


def hourly_activity(history: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    hour = F.hour("timestamp").alias("hour")
    return _in_range(history, start, end).groupBy(hour, "status").agg(F.count("*").alias("count"))


def daily_success_rate(history: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Percent of a day's records that are successes; skips count against it."""
    rate = F.count_if(_is("success")) / F.count("*") * F.lit(100.0)
    day = F.to_date("timestamp").alias("date")
    return _in_range(history, start, end).groupBy(day).agg(rate.alias("success_rate"))


def latest(history: DataFrame, n: int = 20, tie_break: str = "file_path") -> DataFrame:
    """The newest ``n`` records, ties by ``tie_break`` descending."""
    return history.orderBy(F.desc("timestamp"), F.desc(tie_break)).limit(n)


def export_rows(
    history: DataFrame, n: int = 100, tie_break: str = "file_path", oldest: bool = False
) -> DataFrame:
    """The ``n`` records of an export: the newest, or with ``oldest`` the tail
    of a newest-first list."""
    if not oldest:
        return latest(history, n, tie_break)
    return history.orderBy(F.asc("timestamp"), F.asc(tie_break)).limit(n)


def export_history(history: DataFrame, path: str, **options) -> None:
    export_rows(history, **options).write.mode("overwrite").json(path)


def import_history(spark, path: str) -> DataFrame:
    """An exported history; it replaces the caller's."""
    schema = "file_path string, scope string, s3_key string, status string, message string, size long, timestamp timestamp_ntz"
    return spark.read.schema(schema).json(path)


def job_states(job_events: DataFrame) -> DataFrame:
    """Jobs by their latest state, from rows (job, state, ts, seq). Each job
    counts once; ``seq`` orders events of one time."""
    order = F.struct("ts", "seq")
    last = job_events.groupBy("job").agg(F.max_by("state", order).alias("state"))
    return last.agg(
        F.count_if(F.col("state") == "queued").alias("queued"),
        F.count_if(F.col("state") == "processed").alias("processed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count("*").alias("total"),
    )


def worker_totals(finished: DataFrame) -> DataFrame:
    """Processed and failed jobs per worker and, as worker ``all``, in total,
    from rows (worker, state)."""
    processed, failed = F.count_if(F.col("state") == "processed"), F.count_if(F.col("state") == "failed")
    label = F.when(F.grouping("worker") == 1, F.lit("all")).otherwise(F.col("worker"))
    return (
        finished.rollup("worker")
        .agg(
            label.alias("label"),
            processed.alias("processed"),
            failed.alias("failed"),
            F.try_divide(processed * F.lit(100.0), processed + failed).alias("success_rate"),
        )
        .select(F.col("label").alias("worker"), "processed", "failed", "success_rate")
    )
