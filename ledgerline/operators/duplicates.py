"""Files with equal content: groups, markers, totals, partners, report.

Input rows: ``path, size, modified, hash``. Rows without a hash (unreadable
files) take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators.spread import hash_bucket, number_hashes, slice_of

# Texts of the report.
RULE = "=" * 50
TITLE = "Duplicate Detection Report"


def with_hash(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Hex digest of ``content``; any other algorithm name means SHA-256."""
    content = F.col("content")
    digest = F.md5(content) if algorithm == "md5" else F.sha2(content, 256)
    return files.withColumn("hash", digest)


def _hashed(files: DataFrame, *more: str) -> DataFrame:
    return files.select("path", "size", "modified", "hash", *more).where(
        F.col("hash").isNotNull() & (F.col("hash") != "")
    )


def group_totals(files: DataFrame) -> DataFrame:
    """Copies and size per hash, for hashes with more than one file."""
    return (
        _hashed(files)
        .groupBy("hash")
        .agg(F.count("*").alias("copies"), F.max("size").alias("size"))
        .where("copies > 1")
    )


def duplicate_stats(files: DataFrame) -> DataFrame:
    """Groups, files beyond the first of each group, and their megabytes."""
    extra = F.col("copies") - 1
    return group_totals(files).agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("total_duplicates"),
        F.coalesce(names.megabytes(F.sum(extra * F.col("size"))), F.lit(0.0)).alias("wasted_mb"),
    )


def _slices(files: DataFrame, *marks: str) -> tuple[DataFrame, DataFrame]:
    """The files cut into slices of their group, and one row per slice with
    the whole group's ``copies`` and ``first`` (earliest, then by path), and
    the smallest value of each mark column.

    Both read one shuffle of the files, so contents are hashed once: callers
    keep every column of the files, as a narrower read would be a second
    shuffle. A group gives at most as many slice rows as there are slices,
    however many copies it has; only those are gathered per group.
    """
    sliced = _hashed(files, *marks).withColumn("_slice", slice_of("path")).repartition("hash", "_slice")
    parts = (
        sliced.groupBy("hash", "_slice")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("modified", "path", "size")).alias("first"),
            *[F.min(m).alias(m) for m in marks],
        )
        .withColumn("_bucket", hash_bucket("hash"))
    )
    group = Window.partitionBy("_bucket", "hash")
    totals = parts.repartition("_bucket").select(
        "hash",
        "_slice",
        F.sum("n").over(group).alias("copies"),
        F.min("first").over(group).alias("first"),
        *[F.min(m).over(group).alias(m) for m in marks],
    )
    return sliced, totals.where("copies > 1")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Every file that has copies: group number, copies, marker.

    Groups are numbered in hash order. The earliest file of a group (ties by
    path) is ``oldest``, the others ``duplicate``.
    """
    return _numbered(*_slices(files))


def _numbered(sliced: DataFrame, totals: DataFrame) -> DataFrame:
    numbered = number_hashes(totals, "hash", "group_no")
    is_first = F.col("path") == F.col("first.path")
    return sliced.join(numbered, ["hash", "_slice"]).select(
        "group_no",
        "hash",
        "copies",
        "path",
        "size",
        "modified",
        F.when(is_first, F.lit("oldest")).otherwise(F.lit("duplicate")).alias("marker"),
    )


def partner_counts(files: DataFrame) -> DataFrame:
    """Every file with the number of other files of its content, and the
    earliest of the group. The partners themselves are the rows of one hash;
    pairs are never written out."""
    sliced, totals = _slices(files)
    found = totals.select("hash", "_slice", "copies", F.col("first.path").alias("oldest_path"))
    return sliced.join(found, ["hash", "_slice"], "left").select(
        "path",
        "size",
        "modified",
        "hash",
        F.coalesce(F.col("copies") - 1, F.lit(0)).alias("partners"),
        "oldest_path",
    )


def partners_of(files: DataFrame, targets: DataFrame) -> DataFrame:
    """The copies of given files: rows ``target_path, path``, for each target
    all other files of its content.

    ``targets`` holds the few paths a caller asks about, in ``target_path``;
    several may belong to one group. Their hashes pick the files in one join,
    which Spark broadcasts or splits by the sizes it finds; groups that nobody
    asks about are neither shuffled again nor counted. ``files`` is read
    twice: give it hashes that are saved, not taken on the way.
    """
    asked = targets.select("target_path").distinct()
    hashed = _hashed(files)
    wanted = hashed.join(asked, hashed["path"] == asked["target_path"]).select(
        F.col("hash").alias("wanted"), "target_path"
    )
    return (
        hashed.join(wanted, hashed["hash"] == wanted["wanted"])
        .where("target_path <> path")
        .select("target_path", "path", "size", "modified")
    )


def reuse_hashes(files: DataFrame, state: DataFrame) -> DataFrame:
    """Known hashes of unchanged files: ``hash`` from the state when path, size
    and modification time agree, else NULL (the file must be read again)."""
    known = state.select("path", "size", "modified", F.nullif("hash", F.lit("")).alias("hash"))
    return files.select("path", "size", "modified").join(known, ["path", "size", "modified"], "left")


def duplicate_report(files: DataFrame, base_dir: str | None = None) -> DataFrame:
    """The report as lines of text, in the order of `REPORT_ORDER`."""
    sliced, totals = _slices(files)
    groups = _numbered(sliced, totals)
    lead = f"{base_dir.rstrip('/')}/" if base_dir else None
    path = F.col("path")
    shown = names.base_name(path)
    if lead:
        shown = F.when(path.startswith(lead), path.substr(F.lit(len(lead) + 1), F.length(path))).otherwise(shown)
    when = F.date_format("modified", "yyyy-MM-dd HH:mm:ss")

    def line(part: int, number: int, text, modified=F.lit(""), file=F.lit("")):
        return F.struct(
            F.lit(part).alias("part"),
            modified.alias("modified"),
            file.alias("path"),
            F.lit(number).alias("line"),
            text.alias("text"),
        )

    file_lines = F.array(
        line(1, 0, F.concat(F.lit("  - "), shown, F.lit(" ("), "marker", F.lit(")")), when, path),
        line(1, 1, F.concat(F.lit("    Size: "), F.format_number("size", 0), F.lit(" bytes")), when, path),
        line(1, 2, F.concat(F.lit("    Modified: "), when), when, path),
    )
    # The earliest file of a group also carries the lines around it.
    head = F.format_string("Group %d (%d files):", "group_no", "copies")
    around = F.array(line(0, 0, head), line(2, 0, F.lit("")))
    oldest = F.col("marker") == "oldest"
    lines = F.when(oldest, F.concat(around, file_lines)).otherwise(file_lines)
    body = groups.select(F.lit(1).alias("section"), "group_no", F.inline(lines))

    found = F.format_string("Found %d duplicate files in %d groups", "total_duplicates", "groups")
    some = F.array(line(0, 3, found), line(0, 4, F.lit("")))
    none = F.array(line(0, 3, F.lit("No duplicates found")))
    title = F.array(*[line(0, i, F.lit(t)) for i, t in enumerate((RULE, TITLE, RULE))])
    # Of the slice rows of a group, the one with its earliest file stands for it.
    stats = totals.where(F.col("_slice") == slice_of("first.path")).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("total_duplicates")
    )
    ends = stats.select(F.explode(F.array(F.lit(0), F.lit(2))).alias("section"), "*")
    top = F.concat(title, F.when(F.col("groups") > 0, some).otherwise(none))
    frame = ends.select(
        "section",
        F.lit(0).cast("long").alias("group_no"),
        F.inline(F.when(F.col("section") == 0, top).otherwise(F.array(line(0, 0, F.lit(RULE))))),
    )
    return frame.unionByName(body)


REPORT_ORDER = ["section", "group_no", "part", "modified", "path", "line"]
