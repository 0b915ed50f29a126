"""Directory to transfer plan: discovery, targets, comparison, figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import duplicates, history, remote
from ledgerline.sources import files as file_source


def plan_directory(
    spark: SparkSession,
    root: str,
    listing: DataFrame,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    scope: str | None = None,
    auto_scope: bool = True,
    **options: bool,
) -> DataFrame:
    """The action for every file below ``root``, against a listing; ``options``
    are those of `remote.transfer_plan`. ``scope`` narrows the search and is
    the scope of files whose path names none."""
    found = file_source.discover_files(spark, root, include, exclude, scope)
    targets = remote.with_target(found.drop("scope"), root, scope, auto_scope)
    return remote.transfer_plan(targets, listing, **options)


def plan_results(plan: DataFrame, ts) -> DataFrame:
    """A plan as upload results, the input of the history."""
    return plan.select("path", (F.col("action") != "fail").alias("success"), "message", "size", ts.alias("ts"))


def plan_stats(plan: DataFrame, root: str) -> DataFrame:
    """Total, uploaded, skipped, failed and the success rate of a plan."""
    records = history.upload_records(plan_results(plan, F.lit(None).cast("timestamp_ntz")), root)
    return history.batch_stats(records)


def local_duplicates(spark: SparkSession, root: str, state_dir: str) -> DataFrame:
    """Groups of equal files below ``root``, hashing only what changed."""
    return duplicates.duplicate_groups(file_source.refresh_hashes(spark, root, state_dir))
