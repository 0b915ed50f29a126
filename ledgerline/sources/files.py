"""File trees: listing, discovery, content hashes and their saved state.

Listing and hashing run in Spark tasks. Tasks open files through Arrow's file
systems (local, HDFS, S3), so a hash is taken in chunks and a file's content
never becomes a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import inventory
from ledgerline.operators.duplicates import reuse_hashes
from ledgerline.session import checkpointed

LISTED = "path string, size long, modified timestamp_ntz"
CHUNK = 1 << 20
ROWS_PER_BATCH = 10_000


def open_path(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    local = re.sub("^file:/*", "/", path)
    if local.startswith("/"):
        return arrow_fs.LocalFileSystem(), local
    return arrow_fs.FileSystem.from_uri(path)


def plain_path(c: Column) -> Column:
    """A path as Spark's file sources report it, without a local scheme."""
    return F.regexp_replace(c, "^file:/*", "/")


def metadata_path() -> Column:
    """The file of each row of a file scan; Spark reports it URL-encoded."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.url_decode(encoded))


def _lead(root: str) -> str:
    """What an Arrow path lacks to be the caller's kind of path."""
    if re.match("^(file:|/)", root):
        return ""
    _, inside = open_path(root)
    return root[: len(root) - len(inside)] if root.endswith(inside) else root.split("://")[0] + "://"


def _entries(infos: Iterable[arrow_fs.FileInfo], lead: str) -> Iterator[pd.DataFrame]:
    """Files and directories as batches of rows."""
    rows = []
    for info in infos:
        is_file = info.type == arrow_fs.FileType.File
        if is_file or info.type == arrow_fs.FileType.Directory:
            when = info.mtime.replace(tzinfo=None) if is_file else None
            rows.append((lead + info.path, info.size if is_file else 0, when, is_file))
        if len(rows) >= ROWS_PER_BATCH:
            yield pd.DataFrame(rows, columns=["path", "size", "modified", "is_file"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["path", "size", "modified", "is_file"])


def list_files(spark: SparkSession, root: str, recursive: bool = True, levels: int | None = None) -> DataFrame:
    """All files below ``root``, hidden ones too: path, size, modified.

    Directories are listed by tasks, level by level until none is left; each
    level is listed once and kept in the shared folder before the next. With
    ``levels`` whole subtrees below that many levels are left to one task each.
    A missing root, or one that is not a directory, is an error.
    """
    system, inside = open_path(root)
    kind = system.get_file_info(inside).type
    if kind == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"input directory does not exist: {root}")
    if kind != arrow_fs.FileType.Directory:
        raise NotADirectoryError(f"input path is not a directory: {root}")
    lead = _lead(root)

    def listed(directories: DataFrame, deep: bool) -> DataFrame:
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for directory in batch["path"]:
                    where, path = open_path(directory)
                    yield from _entries(where.get_file_info(arrow_fs.FileSelector(path, recursive=deep)), lead)

        return directories.select("path").mapInPandas(walk, f"{LISTED}, is_file boolean")

    entries = checkpointed(listed(spark.createDataFrame([(root,)], "path string"), deep=False))
    found, level = entries.where("is_file"), 0
    while recursive and level != levels and not entries.where("NOT is_file").isEmpty():
        level += 1
        below = entries.where("NOT is_file").repartition(F.xxhash64("path"))
        entries = checkpointed(listed(below, deep=level == levels))
        found = found.unionByName(entries.where("is_file"))
    return found.drop("is_file")


def discover_files(
    spark: SparkSession,
    root: str,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Files with an extension below ``root``, or below ``root/scope`` when
    that directory exists, with category and scope."""
    start = root
    if scope:
        system, inside = open_path(f"{root.rstrip('/')}/{scope}")
        if system.get_file_info(inside).type == arrow_fs.FileType.Directory:
            start = f"{root.rstrip('/')}/{scope}"
    kept = inventory.filter_files(list_files(spark, start), include, exclude)
    return inventory.classify(kept, root)


def hash_files(files: DataFrame, algorithm: str = "md5", path: str = "path") -> DataFrame:
    """Add the hex digest of each file's content as ``hash``, "" for a file
    that cannot be read. Any algorithm but md5 means SHA-256."""
    name = "md5" if algorithm == "md5" else "sha256"

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: _digest(p, name))

    return files.withColumn("hash", digest(F.col(path)))


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt over tasks by path, so that reading them is not left to as
    many tasks as their table happens to have."""
    return files.repartition(F.xxhash64("path"))


def _digest(path: str, algorithm: str) -> str:
    state = hashlib.new(algorithm)
    try:
        system, inside = open_path(path)
        with system.open_input_stream(inside) as stream:
            while chunk := stream.read(CHUNK):
                state.update(chunk)
    except OSError:
        return ""
    return state.hexdigest()


# A saved state is a base, a table of all files, and the changes since: each
# change is a folder with the files that are new or other, and those that are
# gone. The changes become a new base when they have this share of its rows, or
# are so many; the base before stays until the next, for readers at work.
COMPACT_SHARE, MOST_CHANGES = 0.25, 50
_CHANGE = f"{LISTED}, hash string, gone boolean"


def _saved(state_dir: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a saved state, ``version`` (bases) or ``change``."""
    system, inside = open_path(state_dir)
    entries = system.get_file_info(arrow_fs.FileSelector(inside, allow_not_found=True))
    numbers = [int(m.group(1)) for e in entries if (m := re.fullmatch(rf"{kind}=(\d+)", e.base_name))]
    done = lambda n: system.get_file_info(f"{inside}/{kind}={n}/_SUCCESS").type == arrow_fs.FileType.File
    return sorted(n for n in numbers if done(n))


def _base_and_changes(state_dir: str) -> tuple[int, list[int]]:
    base = max(_saved(state_dir, "version"), default=0)
    return base, [n for n in _saved(state_dir, "change") if n > base]


def _changes(spark: SparkSession, state_dir: str, numbers: list[int]) -> DataFrame:
    folders = [f"{state_dir}/change={n}" for n in numbers]
    return spark.read.schema(f"{_CHANGE}, change long").option("basePath", state_dir).parquet(*folders)


def read_hash_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The latest saved hashes (path, size, modified, hash); empty at first."""
    base, changes = _base_and_changes(state_dir)
    schema = f"{LISTED}, hash string"
    rows = spark.read.schema(schema).parquet(f"{state_dir}/version={base}") if base else spark.createDataFrame([], schema)
    if not changes:
        return rows
    every = rows.withColumns({"gone": F.lit(False), "change": F.lit(0).cast("long")})
    every = every.unionByName(_changes(spark, state_dir, changes))
    last = F.max(F.struct("change", "size", "modified", "hash", "gone")).alias("last")
    return every.groupBy("path").agg(last).where("NOT last.gone").select("path", "last.size", "last.modified", "last.hash")


def refresh_hashes(spark: SparkSession, root: str, state_dir: str) -> DataFrame:
    """Hashes of all files below ``root``. Only files that are new or changed
    since the last saved state are read, and only they and those that are gone
    are written, as the next change of the state."""
    saved = read_hash_state(spark, state_dir)
    # The tree is listed once, so that a file that changes meanwhile is in one half.
    known = checkpointed(reuse_hashes(list_files(spark, root), saved))
    # A hash that is blank in the state was not to be read, and is tried again.
    fresh = hash_files(dealt(known.where("hash IS NULL").drop("hash"))).withColumn("gone", F.lit(False))
    lost = saved.join(known.select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
    change = fresh.unionByName(lost)
    base, changes = _base_and_changes(state_dir)
    number = max([base, *changes]) + 1
    change.write.mode("overwrite").parquet(f"{state_dir}/change={number}")
    _compact(spark, state_dir)
    return read_hash_state(spark, state_dir)


def _compact(spark: SparkSession, state_dir: str) -> None:
    """Make a new base of the state where its changes have grown large."""
    base, changes = _base_and_changes(state_dir)
    rows = spark.read.parquet(f"{state_dir}/version={base}").count() if base else 0
    changed = _changes(spark, state_dir, changes).count()
    if len(changes) < MOST_CHANGES and (base == 0 or changed < COMPACT_SHARE * rows):
        return
    number = changes[-1]
    read_hash_state(spark, state_dir).write.mode("overwrite").parquet(f"{state_dir}/version={number}")
    system, inside = open_path(state_dir)
    for kind, last in (("version", base), ("change", base)):
        for n in _saved(state_dir, kind):
            if n < last or (kind == "change" and n == last):
                system.delete_dir(f"{inside}/{kind}={n}")


def list_objects(manifest: DataFrame, bucket: str, prefix: str = "", max_files: int | None = None) -> DataFrame:
    """The objects of a bucket below a prefix; with ``max_files`` only the
    first of them by key."""
    wanted = manifest.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))
    return wanted if max_files is None else wanted.orderBy("key").limit(max_files)


def store_listing(spark: SparkSession, store_root: str) -> DataFrame:
    """A tree ``store_root/<bucket>/<key>`` as a listing: bucket, key, path,
    size, last_modified."""
    base = f"{re.sub('^file:/*', '/', store_root).rstrip('/')}/"
    rest = F.col("path").substr(F.lit(len(base) + 1), F.length("path"))
    return (
        list_files(spark, store_root)
        .withColumn("bucket", F.substring_index(rest, "/", 1))
        .withColumn("key", rest.substr(F.length("bucket") + 2, F.length("path")))
        .where("key <> ''")
        .select("bucket", "key", "path", "size", F.col("modified").alias("last_modified"))
    )
