"""Local files against an object listing: comparison, similar objects, plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.functions.names import SCOPES, Scope
from ledgerline.operators.spread import lookup_join


def with_target(
    files: DataFrame,
    root: str,
    default_scope: str | None = None,
    auto_scope: bool = True,
    scopes: tuple[Scope, ...] = SCOPES,
) -> DataFrame:
    """Add ``scope``, ``bucket`` and ``key``: where a file would be stored.

    ``auto_scope`` takes the scope from the path first. The last two are NULL
    for a missing or unknown scope.
    """
    default = F.lit(default_scope).cast("string")
    scope = F.coalesce(names.scope_of("path", root), default) if auto_scope else default
    return (
        files.withColumn("scope", scope)
        .withColumn("bucket", names.scope_bucket("scope", scopes))
        .withColumn(
            "key",
            F.when(
                F.col("bucket").isNotNull(),
                names.target_key("scope", "path", names.scope_prefix("scope", scopes)),
            ),
        )
    )


def _listed(remote: DataFrame) -> DataFrame:
    """The listing, one row per object. A listing taken in pages can repeat an
    object; the latest entry stands."""
    entry = F.struct("last_modified", "size", "etag")
    return (
        remote.groupBy("bucket", "key")
        .agg(F.max(entry).alias("object"))
        .select(
            "bucket",
            "key",
            F.col("object.size").alias("remote_size"),
            F.col("object.last_modified").alias("remote_modified"),
            names.clean_etag("object.etag").alias("remote_etag"),
        )
    )


def object_metadata(candidates: DataFrame, remote: DataFrame) -> DataFrame:
    """Candidates (bucket, key, ...) with the metadata of the object of that
    key; ``found`` is false where there is none."""
    listed = _listed(remote).withColumn("found", F.lit(True))
    joined = lookup_join(candidates, listed, ["bucket", "key"], ["path"])
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def compare_with_remote(targets: DataFrame, remote: DataFrame) -> DataFrame:
    """Files with a target against the listing: a file is a duplicate when its
    key exists with the same size; another size keeps the metadata only."""
    same = F.col("found") & (F.col("size") == F.col("remote_size"))
    return object_metadata(targets, remote).withColumn("is_duplicate", F.coalesce(same, F.lit(False)))


def similar_counts(files: DataFrame, remote: DataFrame) -> DataFrame:
    """Per file: how many objects have its name (any case), how many others
    have its size, and the first key of either kind.

    Objects are counted per name, per size and per both before any join, so a
    common size costs one row, not one per object. `similar_to` lists the
    objects for one file.
    """
    objects = remote.select("key", "size", F.lower(names.base_name("key")).alias("name"))
    by_both = objects.groupBy("size", "name").agg(F.count("*").alias("n_both"), F.min("key").alias("first_both"))
    by_name = by_both.groupBy("name").agg(
        F.sum("n_both").alias("n_name"), F.min("first_both").alias("first_name")
    )
    by_size = by_both.groupBy("size").agg(F.sum("n_both").alias("n_size"))
    local = files.select("path", "size", F.lower(names.base_name("path")).alias("name"))
    matched = lookup_join(local, by_name, ["name"], ["path"])
    matched = lookup_join(matched, by_size, ["size"], ["path"], keys=local)
    matched = lookup_join(matched, by_both.drop("first_both"), ["size", "name"], ["path"], keys=local)
    n_both, n_size = F.coalesce("n_both", F.lit(0)), F.coalesce("n_size", F.lit(0))
    return matched.select(
        "path",
        F.coalesce("n_name", F.lit(0)).alias("same_name"),
        (n_size - n_both).alias("same_size"),
        F.col("first_name").alias("first_same_name"),
    )


def similar_to(file: DataFrame, remote: DataFrame) -> DataFrame:
    """Objects like one local file (one row: path, size): equal name (any
    case) is ``same_name``, else equal size is ``same_size``. Two equi-joins,
    never an OR."""
    one = file.select(F.col("size").alias("local_size"), F.lower(names.base_name("path")).alias("name"))
    objects = remote.withColumn("name", F.lower(names.base_name("key")))
    named = objects.join(one.select("name"), "name", "left_semi").withColumn("similarity", F.lit("same_name"))
    sized = (
        objects.join(one, F.col("size") == F.col("local_size"), "left_semi")
        .join(one.select("name"), "name", "left_anti")
        .withColumn("similarity", F.lit("same_size"))
    )
    return named.unionByName(sized).drop("name")


def transfer_plan(
    targets: DataFrame,
    remote: DataFrame,
    check_remote: bool = True,
    overwrite: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """What to do with each file: ``action`` upload, skip or fail, ``message``.

    ``targets`` is the result of `with_target`.
    """
    where = F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key")
    no_scope = F.col("scope").isNull()
    bad_scope = F.col("bucket").isNull()
    upload: Column = where if dry_run else F.concat(F.lit("Uploaded to "), where)
    # The messages of a transfer.
    action = F.when(no_scope | bad_scope, F.lit("fail"))
    message = F.when(no_scope, F.lit("Could not determine scope for file")).when(
        bad_scope, F.concat(F.lit("Invalid scope: "), "scope")
    )
    if check_remote and not overwrite and not dry_run:
        compared = compare_with_remote(targets, remote)
        same, other = F.col("is_duplicate"), F.col("found")
        action = action.when(same, F.lit("skip")).when(other, F.lit("fail"))
        message = message.when(same, F.concat(F.lit("Skipped - already in S3: "), "key")).when(
            other, F.lit("Exists with different size (use overwrite to replace)")
        )
    else:
        compared = targets
    return compared.select(
        "path",
        "size",
        "scope",
        "bucket",
        "key",
        action.otherwise(F.lit("upload")).alias("action"),
        message.otherwise(upload).alias("message"),
    )


def with_local_duplicates(plan: DataFrame, partners: DataFrame) -> DataFrame:
    """Add to each file of a plan how many other local files have its content
    (from `duplicates.partner_counts`). They change no action."""
    copies = partners.select("path", F.col("partners").alias("local_duplicates"))
    return plan.join(copies, "path", "left").withColumn(
        "local_duplicates", F.coalesce("local_duplicates", F.lit(0)).cast("long")
    )


def listing_view(remote: DataFrame) -> DataFrame:
    """Name, type, size in MB and minute of change of each object."""
    return remote.select(
        "key",
        names.base_name("key").alias("name"),
        names.suffix("key").alias("type"),
        F.round(names.megabytes("size"), 2).alias("size_mb"),
        F.date_format("last_modified", "yyyy-MM-dd HH:mm").alias("modified"),
        names.clean_etag("etag").alias("etag"),
    )


def listing_totals(remote: DataFrame) -> DataFrame:
    return remote.agg(
        F.count("*").alias("files"),
        names.megabytes(F.coalesce(F.sum("size"), F.lit(0))).alias("total_mb"),
        F.count_distinct(names.suffix("key")).alias("types"),
    )
