"""File inventories: extension and scope filters, counts by type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names


def _dotted(extensions: Iterable[str]) -> list[str]:
    return sorted({"." + e.lstrip(".") for e in extensions})


def filter_files(
    files: DataFrame,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> DataFrame:
    """Files with an extension, in ``include`` when that is given, and not in
    ``exclude``. The lists are compared as given: upper case never matches."""
    kept = files.withColumn("ext", names.suffix("path")).where(F.col("ext") != "")
    if include:
        kept = kept.where(F.col("ext").isin(_dotted(include)))
    if exclude:
        kept = kept.where(~F.col("ext").isin(_dotted(exclude)))
    return kept


def in_scope(files: DataFrame, root: str, scope: str | None) -> DataFrame:
    """Files below ``root/scope`` if there are any, else all files.

    Looks for one such file; that look is the only action taken here.
    """
    if not scope:
        return files
    subtree = files.where(F.col("path").startswith(f"{root.rstrip('/')}/{scope}/"))
    return files if subtree.isEmpty() else subtree


def classify(files: DataFrame, root: str) -> DataFrame:
    """Add the category and scope of each file."""
    return files.withColumn("category", names.file_category("path")).withColumn(
        "scope", names.scope_of("path", root)
    )


def extension_counts(files: DataFrame, path: str = "path", no_extension: str = "") -> DataFrame:
    """Files per lower-case extension; ``no_extension`` labels those without."""
    ext = names.suffix(path)
    label = F.when(ext == "", F.lit(no_extension)).otherwise(ext)
    return files.groupBy(label.alias("ext")).agg(F.count("*").alias("files"))
