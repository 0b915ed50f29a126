"""Object-created notices: which records to load, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where CSV files to load arrive, and the texts of the result.
KEY_PREFIX = "mba/csv/"
KEY_SUFFIX = ".csv"
NO_RECORDS = "No S3 records found in event"
MISSING = "Missing bucket or key in S3 record"
WRONG_PREFIX = "Not in mba/csv/ prefix"
WRONG_SUFFIX = "Not a CSV file"


def select_records(records: DataFrame) -> DataFrame:
    """Add ``status`` (load, skipped, failed) and ``reason`` to the records of
    notices; ``status`` is NULL on the one row of a notice without records.

    Keys are compared in any case; the prefix is tested first.
    """
    absent = (F.coalesce("bucket", F.lit("")) == "") | (F.coalesce("key", F.lit("")) == "")
    key = F.lower("key")
    reason = (
        F.when(absent, F.lit(MISSING))
        .when(~key.startswith(KEY_PREFIX), F.lit(WRONG_PREFIX))
        .when(~key.endswith(KEY_SUFFIX), F.lit(WRONG_SUFFIX))
    )
    present = F.col("record_index").isNotNull()
    status = (
        F.when(~present, F.lit(None).cast("string"))
        .when(F.col("reason") == MISSING, F.lit("failed"))
        .when(F.col("reason").isNotNull(), F.lit("skipped"))
        .otherwise(F.lit("load"))
    )
    return records.withColumn("reason", F.when(present, reason)).withColumn("status", status)


def run_summary(results: DataFrame) -> DataFrame:
    """One row per request from rows (request_id, status, rows_inserted) with
    status success, failed, skipped, or NULL for a notice without records.

    Status code 200 without failures, 207 with some, 400 without records.
    """
    status = F.col("status")
    total, processed, bad = F.count(status), F.count_if(status == "success"), F.count_if(status == "failed")
    rate = F.round(F.try_divide(processed * F.lit(100.0), total), 2)
    rows = F.sum(F.when(status == "success", F.col("rows_inserted")))
    return results.groupBy("request_id").agg(
        F.when(total == 0, F.lit(400)).when(bad == 0, F.lit(200)).otherwise(F.lit(207)).alias("status_code"),
        total.alias("total_records"),
        processed.alias("files_processed"),
        bad.alias("files_failed"),
        (total - processed - bad).alias("files_skipped"),
        F.coalesce(rows, F.lit(0)).alias("total_rows_inserted"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate_percent"),
        F.when(total == 0, F.lit(NO_RECORDS)).alias("error"),
    )
