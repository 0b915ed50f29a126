"""Object-created notices as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTICE_SCHEMA = (
    "Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"
)


def parse_notices(notices: DataFrame, body: str = "body") -> DataFrame:
    """One row per record of each notice (request_id, body): record_index,
    bucket, key. A notice without records gives one row with NULLs."""
    parsed = notices.select("request_id", F.from_json(body, NOTICE_SCHEMA).alias("notice"))
    opened = parsed.select("request_id", F.posexplode_outer("notice.Records").alias("record_index", "record"))
    return opened.select(
        "request_id",
        "record_index",
        F.col("record.s3.bucket.name").alias("bucket"),
        F.col("record.s3.object.key").alias("key"),
    )
