"""The registered queries and, next to each, the same question in SQL.

Every query reads whole driver tables; limits appear only where the operator
is a top list or a sample.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.contract import derived
from ledgerline.contract.derived import ROOT, TABLES, table, with_views
from ledgerline.functions import names
from ledgerline.operators import (
    audit,
    benefits,
    deductibles,
    duplicates,
    history,
    inventory,
    members,
    notices,
    profile,
    questions,
    remote,
)
from ledgerline.plans import summary
from ledgerline.sources import csv_files
from ledgerline.sources import notices as notice_source
from ledgerline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, *views)
        return fn

    return add


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.with_hash(derived.files(spark, sf))


# --- Files -----------------------------------------------------------------


@query(
    """
    SELECT path, ext, category,
           CASE WHEN dir IN ('mba', 'policy') THEN dir END AS scope, size
    FROM v_files WHERE ext IN ('.csv', '.pdf', '.txt', '.docx')
    """,
    "v_files",
)
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    include = names.parse_extensions("csv, .PDF,txt,docx,json,csv")
    found = inventory.filter_files(derived.files(spark, sf), include, {"json"})
    return inventory.classify(found, ROOT).select("path", "ext", "category", "scope", "size")


@query("SELECT path, size FROM v_files WHERE dir = 'mba'", "v_files")
def scope_files(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.in_scope(derived.files(spark, sf), ROOT, "mba").select("path", "size")


@query(
    """
    SELECT path, CASE WHEN dir IN ('mba', 'policy') THEN dir END AS scope,
           CASE WHEN dir IN ('mba', 'policy') THEN dir || '-bucket' END AS bucket,
           CASE WHEN dir IN ('mba', 'policy') THEN dir || '/' || category || '/' || name END AS key
    FROM v_files
    """,
    "v_files",
)
def target_keys(spark: SparkSession, sf: str) -> DataFrame:
    return remote.with_target(derived.files(spark, sf), ROOT).select("path", "scope", "bucket", "key")


@query(
    """
    SELECT 'documents' AS source, CASE WHEN ext = '' THEN 'no_ext' ELSE ext END AS ext, count(*) AS files
    FROM v_files GROUP BY 2
    UNION ALL
    SELECT 'pages', CASE WHEN e = '' THEN 'no_ext' ELSE e END, count(*)
    FROM (SELECT lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS e FROM pages) GROUP BY 2
    """,
    "v_files",
)
def extension_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = inventory.extension_counts(derived.files(spark, sf), no_extension="no_ext")
    pages = inventory.extension_counts(table(spark, sf, "pages"), "url", "no_ext")
    return docs.select(F.lit("documents").alias("source"), "*").unionByName(
        pages.select(F.lit("pages").alias("source"), "*")
    )


@query(
    """
    SELECT key, name, ext AS type, round(size / 1048576.0, 2) AS size_mb,
           strftime(last_modified, '%Y-%m-%d %H:%M') AS modified, etag
    FROM v_listing
    """,
    "v_listing",
)
def listing_view(spark: SparkSession, sf: str) -> DataFrame:
    return remote.listing_view(derived.remote(spark, sf, every=True))


@query(
    """
    SELECT count(*) AS files, sum(size) / 1048576.0 AS total_mb, count(DISTINCT ext) AS types FROM v_listing
    """,
    "v_listing",
)
def listing_totals(spark: SparkSession, sf: str) -> DataFrame:
    return remote.listing_totals(derived.remote(spark, sf, every=True))


_GROUPS = """
    , g AS (SELECT hash, count(*) AS copies, any_value(size) AS size FROM v_files GROUP BY hash HAVING count(*) > 1),
    n AS (SELECT *, row_number() OVER (ORDER BY hash) AS group_no FROM g),
    f AS (SELECT v.*, n.copies, n.group_no,
                 row_number() OVER (PARTITION BY v.hash ORDER BY modified, path) AS pos
          FROM v_files v JOIN n USING (hash))
"""


def _with_groups(body: str) -> str:
    return with_views("", "v_files").rstrip() + _GROUPS + body.strip()


@query()
def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = duplicates.duplicate_groups(_hashed(spark, sf))
    return rows.select("group_no", "hash", "copies", "path", "size", _time("modified"), "marker")


ORACLES["dup_groups"] = _with_groups(
    """
    SELECT group_no, hash, copies, path, size, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified,
           CASE WHEN pos = 1 THEN 'oldest' ELSE 'duplicate' END AS marker
    FROM f
    """
)


@query()
def dup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_stats(_hashed(spark, sf))


ORACLES["dup_stats"] = _with_groups(
    """
    SELECT count(*) AS groups, CAST(sum(copies - 1) AS BIGINT) AS total_duplicates,
           CAST(sum((copies - 1) * size) AS DOUBLE) / 1048576.0 AS wasted_mb
    FROM g
    """
)


@query(
    """
    SELECT path, size, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified, hash, count(*) OVER (PARTITION BY hash) - 1 AS partners,
           CASE WHEN count(*) OVER (PARTITION BY hash) > 1
                THEN first_value(path) OVER (PARTITION BY hash ORDER BY modified, path) END AS oldest_path
    FROM v_files
    """,
    "v_files",
)
def dup_partners(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.partner_counts(_hashed(spark, sf)).withColumn("modified", _time("modified"))


@query()
def dup_partners_of_file(spark: SparkSession, sf: str) -> DataFrame:
    """The copies of every file whose number is divisible by 20."""
    number = F.regexp_extract("path", "[0-9]+", 0).try_cast("long")
    asked = derived.files(spark, sf).where(number % 20 == 0).select(F.col("path").alias("target_path"))
    found = duplicates.partners_of(_hashed(spark, sf), asked)
    return found.select("target_path", "path", "size", _time("modified"))


ORACLES["dup_partners_of_file"] = with_views(
    """
    SELECT t.path AS target_path, v.path, v.size, strftime(v.modified, '%Y-%m-%d %H:%M:%S') AS modified
    FROM v_files t JOIN v_files v ON v.hash = t.hash AND v.path <> t.path
    WHERE TRY_CAST(regexp_extract(t.path, '[0-9]+') AS BIGINT) % 20 = 0
    """,
    "v_files",
)


@query()
def dup_report(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_report(_hashed(spark, sf), ROOT)


ORACLES["dup_report"] = _with_groups(
    """
    SELECT 0 AS section, CAST(0 AS BIGINT) AS group_no, 0 AS part, '' AS modified, '' AS path, CAST(i AS INTEGER) AS line, t AS text
    FROM (SELECT repeat('=', 50) AS a, 'Found ' || sum(copies - 1) || ' duplicate files in ' || count(*) || ' groups' AS b FROM g),
         LATERAL (VALUES (0, a), (1, 'Duplicate Detection Report'), (2, a), (3, b), (4, '')) u(i, t)
    UNION ALL SELECT 2, 0, 0, '', '', 0, repeat('=', 50)
    UNION ALL SELECT 1, group_no, 0, '', '', 0, 'Group ' || group_no || ' (' || copies || ' files):' FROM n
    UNION ALL SELECT 1, group_no, 2, '', '', 0, '' FROM n
    UNION ALL
    SELECT 1, group_no, 1, strftime(modified, '%Y-%m-%d %H:%M:%S'), path, CAST(i AS INTEGER),
           CASE i WHEN 0 THEN '  - ' || substr(path, 7) || CASE WHEN pos = 1 THEN ' (oldest)' ELSE ' (duplicate)' END
                  WHEN 1 THEN '    Size: ' || format('{:,}', size) || ' bytes'
                  ELSE '    Modified: ' || strftime(modified, '%Y-%m-%d %H:%M:%S') END
    FROM f, range(3) r(i)
    """
)


@query(
    """
    SELECT path, CASE WHEN doc_id % 4 <> 0 AND NOT size % 3 = 0 THEN hash END AS hash FROM v_files
    """,
    "v_files",
)
def hash_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Files against an older state in which some are absent and some changed."""
    files = derived.files(spark, sf)
    state = (
        duplicates.with_hash(files)
        .where("doc_id % 4 <> 0")
        .withColumn("size", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    )
    return duplicates.reuse_hashes(files, state).select("path", "hash")


@query(
    """
    SELECT f.path, f.bucket, f.key, r.key IS NOT NULL AS found, r.size AS remote_size,
           strftime(r.last_modified, '%Y-%m-%d %H:%M:%S') AS remote_modified, r.etag AS remote_etag,
           coalesce(f.size = r.size, false) AS is_duplicate
    FROM (SELECT path, size, CASE dir WHEN 'policy' THEN 'policy' ELSE 'mba' END || '-bucket' AS bucket,
                 CASE dir WHEN 'policy' THEN 'policy' ELSE 'mba' END || '/' || category || '/' || name AS key FROM v_files) f
    LEFT JOIN v_remote r ON f.bucket = r.bucket AND f.key = r.key
    """,
    "v_files",
    "v_remote",
)
def remote_compare(spark: SparkSession, sf: str) -> DataFrame:
    targets = remote.with_target(derived.files(spark, sf), ROOT, default_scope="mba")
    compared = remote.compare_with_remote(targets, derived.remote(spark, sf))
    return compared.select(
        "path", "bucket", "key", "found", "remote_size", _time("remote_modified"), "remote_etag", "is_duplicate"
    )


@query(
    """
    SELECT count(*) FILTER (WHERE same) AS already_stored, count(*) FILTER (WHERE NOT same) AS not_stored
    FROM (SELECT coalesce(f.size = r.size, false) AS same
          FROM (SELECT size, CASE dir WHEN 'policy' THEN 'policy' ELSE 'mba' END || '-bucket' AS bucket,
                       CASE dir WHEN 'policy' THEN 'policy' ELSE 'mba' END || '/' || category || '/' || name AS key FROM v_files) f
          LEFT JOIN v_remote r ON f.bucket = r.bucket AND f.key = r.key)
    """,
    "v_files",
    "v_remote",
)
def remote_matches(spark: SparkSession, sf: str) -> DataFrame:
    targets = remote.with_target(derived.files(spark, sf), ROOT, default_scope="mba")
    compared = remote.compare_with_remote(targets, derived.remote(spark, sf))
    return compared.agg(
        F.count_if("is_duplicate").alias("already_stored"), F.count_if(~F.col("is_duplicate")).alias("not_stored")
    )


@query(
    """
    SELECT f.path, coalesce(n.n, 0) AS same_name, coalesce(s.n, 0) - coalesce(b.n, 0) AS same_size,
           n.k AS first_same_name
    FROM v_files f
    LEFT JOIN (SELECT lower(name) AS name, count(*) AS n, min(key) AS k FROM v_remote GROUP BY 1) n ON n.name = lower(f.name)
    LEFT JOIN (SELECT size, count(*) AS n FROM v_remote GROUP BY 1) s ON s.size = f.size
    LEFT JOIN (SELECT lower(name) AS name, size, count(*) AS n FROM v_remote GROUP BY 1, 2) b
           ON b.size = f.size AND b.name = lower(f.name)
    """,
    "v_files",
    "v_remote",
)
def similar_objects(spark: SparkSession, sf: str) -> DataFrame:
    return remote.similar_counts(derived.files(spark, sf), derived.remote(spark, sf))


@query(
    """
    , c AS (SELECT size FROM v_remote GROUP BY size ORDER BY count(*) DESC, size LIMIT 1),
    o AS (SELECT f.size, f.name FROM v_files f JOIN c USING (size) ORDER BY path LIMIT 1)
    SELECT r.key, r.size, r.etag, CASE WHEN lower(r.name) = lower(o.name) THEN 'same_name' ELSE 'same_size' END AS similarity
    FROM v_remote r, o WHERE lower(r.name) = lower(o.name) OR r.size = o.size
    """,
    "v_files",
    "v_remote",
)
def similar_to_file(spark: SparkSession, sf: str) -> DataFrame:
    """Objects like one file: the first by path with the commonest object size."""
    files, listing = derived.files(spark, sf), derived.remote(spark, sf)
    common = listing.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)
    one = files.join(common.select("size"), "size").orderBy("path").limit(1)
    found = remote.similar_to(one, listing)
    return found.select("key", "size", names.clean_etag("etag").alias("etag"), "similarity")


@query(
    """
    SELECT f.path, f.size, f.scope, f.bucket, f.key,
           CASE WHEN f.scope IS NULL THEN 'fail' WHEN r.key IS NULL THEN 'upload'
                WHEN r.size = f.size THEN 'skip' ELSE 'fail' END AS action,
           CASE WHEN f.scope IS NULL THEN 'Could not determine scope for file'
                WHEN r.key IS NULL THEN 'Uploaded to s3://' || f.bucket || '/' || f.key
                WHEN r.size = f.size THEN 'Skipped - already in S3: ' || f.key
                ELSE 'Exists with different size (use overwrite to replace)' END AS message,
           local_duplicates
    FROM (SELECT path, size, count(*) OVER (PARTITION BY hash) - 1 AS local_duplicates, CASE WHEN dir <> 'misc' THEN dir END AS scope, CASE WHEN dir <> 'misc' THEN dir || '-bucket' END AS bucket,
                 CASE WHEN dir <> 'misc' THEN dir || '/' || category || '/' || name END AS key FROM v_files) f
    LEFT JOIN v_remote r ON f.bucket = r.bucket AND f.key = r.key
    """,
    "v_files",
    "v_remote",
)
def upload_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = remote.transfer_plan(remote.with_target(derived.files(spark, sf), ROOT), derived.remote(spark, sf))
    return remote.with_local_duplicates(plan, duplicates.partner_counts(_hashed(spark, sf)))


# --- History and jobs ------------------------------------------------------


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return history.upload_records(derived.upload_results(spark, sf), ROOT)


@query(
    """
    SELECT file_path, scope, s3_key, status, message, size, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM v_history
    """,
    "v_history",
)
def upload_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = _history(spark, sf)
    return rows.select("file_path", "scope", "s3_key", "status", "message", "size", _time("timestamp"))


@query(
    """
    SELECT scope, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS uploaded, count(*) FILTER (WHERE status = 'skipped') AS skipped,
           count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status <> 'failed') * 100.0::DOUBLE / count(*) AS success_rate
    FROM v_history GROUP BY scope
    """,
    "v_history",
)
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return history.batch_stats(_history(spark, sf), ["scope"])


@query(
    """
    SELECT count(*) FILTER (WHERE status = 'success') AS total_uploaded, count(*) FILTER (WHERE status = 'skipped') AS total_skipped,
           count(*) FILTER (WHERE status = 'failed') AS total_failed,
           CAST(sum(size) FILTER (status = 'success') AS BIGINT) AS total_size,
           CAST(sum(size) FILTER (status = 'success') AS DOUBLE) / 1048576.0 AS total_mb
    FROM v_history
    """,
    "v_history",
)
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    return history.running_totals(_history(spark, sf))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, status, count(*) AS count FROM v_history GROUP BY 1, 2", "v_history")
def daily_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.daily_trend(_history(spark, sf))
    return rows.select(F.col("date").cast("string").alias("date"), "status", "count")


@query(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS date, status, count(*) AS count FROM v_history
    WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15' GROUP BY 1, 2
    """,
    "v_history",
)
def daily_trend_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.daily_trend(_history(spark, sf), "2024-01-08", "2024-01-14")
    return rows.select(F.col("date").cast("string").alias("date"), "status", "count")


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, status, count(*) AS count FROM v_history GROUP BY 1, 2", "v_history")
def hourly_activity(spark: SparkSession, sf: str) -> DataFrame:
    return history.hourly_activity(_history(spark, sf))


@query(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS date,
           count(*) FILTER (WHERE status = 'success')::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS success_rate
    FROM v_history GROUP BY 1
    """,
    "v_history",
)
def daily_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.daily_success_rate(_history(spark, sf))
    return rows.select(F.col("date").cast("string").alias("date"), "success_rate")


@query(
    """
    SELECT file_path, scope, status, size, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM v_history ORDER BY ts DESC, file_path DESC LIMIT 20
    """,
    "v_history",
)
def latest_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.latest(_history(spark, sf))
    return rows.select("file_path", "scope", "status", "size", _time("timestamp"))


@query(
    """
    SELECT 'newest' AS kind, file_path, status FROM (SELECT * FROM v_history ORDER BY ts DESC, file_path DESC LIMIT 100)
    UNION ALL
    SELECT 'oldest', file_path, status FROM (SELECT * FROM v_history ORDER BY ts, file_path LIMIT 100)
    """,
    "v_history",
)
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _history(spark, sf)
    kinds = {
        kind: history.export_rows(rows, oldest=kind == "oldest").select(F.lit(kind).alias("kind"), "file_path", "status")
        for kind in ("newest", "oldest")
    }
    return kinds["newest"].unionByName(kinds["oldest"])


@query(
    """
    SELECT count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'processed') AS processed,
           count(*) FILTER (WHERE state = 'failed') AS failed, count(*) AS total
    FROM (SELECT job, state, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS r FROM v_jobs) WHERE r = 1
    """,
    "v_jobs",
)
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return history.job_states(derived.job_events(spark, sf))


@query(
    """
    SELECT coalesce(worker, 'all') AS worker, count(*) FILTER (WHERE state = 'processed') AS processed, count(*) FILTER (WHERE state = 'failed') AS failed,
           count(*) FILTER (WHERE state = 'processed') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE state <> 'queued'), 0) AS success_rate
    FROM v_jobs GROUP BY ROLLUP (worker)
    """,
    "v_jobs",
)
def worker_totals(spark: SparkSession, sf: str) -> DataFrame:
    return history.worker_totals(derived.job_events(spark, sf))


# --- Profiles --------------------------------------------------------------


@query(
    r"""
    SELECT source, text, CASE WHEN t = '' THEN 'col' ELSE lower(regexp_replace(t, '^([0-9])', 'c_\1')) END AS snake
    FROM (SELECT *, trim(regexp_replace(text, '[^0-9a-zA-Z]+', '_', 'g'), '_') AS t
          FROM (SELECT DISTINCT 'type' AS source, p_type AS text FROM part
                UNION ALL SELECT DISTINCT 'brand', p_brand FROM part
                UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders
                UNION ALL SELECT 'file', name FROM (SELECT regexp_replace(name, '\.[^.]*$', '') AS name FROM v_files)))
    """,
    "v_files",
)
def snake_headers(spark: SparkSession, sf: str) -> DataFrame:
    part, orders = table(spark, sf, "part"), table(spark, sf, "orders")

    def words(df: DataFrame, source: str, c: str) -> DataFrame:
        return df.select(F.lit(source).alias("source"), F.col(c).alias("text")).distinct()

    headers = words(part, "type", "p_type").unionByName(words(part, "brand", "p_brand"))
    headers = headers.unionByName(words(orders, "priority", "o_orderpriority"))
    files = derived.files(spark, sf).select(
        F.lit("file").alias("source"),
        F.regexp_replace(names.base_name("path"), r"\.[^.]*$", "").alias("text"),
        names.table_name("path").alias("snake"),
    )
    return headers.withColumn("snake", names.snake_case("text")).unionByName(files)


_PROFILE = "file, ordinal, name, snake, is_int, is_float, is_bool, is_date, is_datetime, max_len, nullable"


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    tables = derived.csv_tables(spark, sf)
    return reduce(DataFrame.unionByName, [profile.profile_rows(rows, file) for file, rows in tables.items()])


@query(f"SELECT {_PROFILE} FROM v_types", "v_types")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).selectExpr(*_PROFILE.split(", "))


@query("SELECT file, ordinal, snake, nullable, column_type FROM v_types", "v_types")
def column_types(spark: SparkSession, sf: str) -> DataFrame:
    typed = profile.with_types(_profiles(spark, sf))
    return typed.select("file", "ordinal", "snake", "nullable", "column_type")


@query(
    """
    SELECT table_name, 'CREATE TABLE IF NOT EXISTS `' || table_name || '` (' || chr(10)
           || string_agg('  `' || snake || '` ' || column_type || CASE WHEN nullable THEN ' NULL' ELSE ' NOT NULL' END,
                         ',' || chr(10) ORDER BY ordinal)
           || chr(10) || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;' AS ddl
    FROM (SELECT *, replace(file, '.csv', '') AS table_name FROM v_types) GROUP BY table_name
    """,
    "v_types",
)
def table_ddl(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_definitions(_profiles(spark, sf).withColumn("table_name", names.table_name("file")))


@query(
    """
    WITH files AS (
      SELECT p_partkey, p_brand, p_size, CASE p_partkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS mark
      FROM part),
    lines AS (
      SELECT p_partkey, CASE WHEN i = 0 THEN 'a' || mark || 'b' || mark || 'c'
                             WHEN i % (CASE WHEN p_partkey % 10 = 3 THEN 2 ELSE 20 END) = 1 THEN p_brand
                             ELSE p_brand || mark || i || mark || '"' || p_size || ',' || chr(10) || ';"' END AS line
      FROM files, range(31) r(i)),
    counts AS (
      SELECT p_partkey, d, pos, len(bare) - len(replace(bare, d, '')) AS n, count(*) AS seen
      FROM (SELECT p_partkey, regexp_replace(line, '"[^"]*"', '', 'g') AS bare FROM lines),
           (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) v(d, pos)
      GROUP BY ALL)
    SELECT p.p_partkey, coalesce(c.d, ',') AS delimiter
    FROM part p LEFT JOIN (SELECT p_partkey, arg_min(d, pos) AS d FROM counts WHERE n > 0 AND seen >= 0.9 * 31 GROUP BY p_partkey) c
      USING (p_partkey)
    """
)
def delimiter_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The delimiter of a small file made of each part: four separators, some
    short records, and files where too many are short."""
    number, mark = F.col("p_partkey"), F.element_at(F.array(*map(F.lit, ",;\t|")), (F.col("p_partkey") % 4 + 1).cast("int"))
    every = F.when(number % 10 == 3, F.lit(2)).otherwise(F.lit(20))
    quoted = F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit(',\n;"'))
    record = lambda i: F.when(i % every == 1, F.col("p_brand")).otherwise(
        F.concat_ws(mark_text, F.col("p_brand"), i.cast("string"), quoted)
    )
    mark_text = "\x00"
    body = F.transform(F.sequence(F.lit(1), F.lit(30)), record)
    text = F.array_join(F.concat(F.array(F.lit(mark_text.join("abc"))), body), "\n")
    # A row is short and its file long: rows are dealt out evenly first, to a fixed
    # number of tasks, as their bytes do not tell the work.
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("p_partkey", csv_files.delimiter_of(F.replace(text, F.lit(mark_text), mark)).alias("delimiter"))


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS name
    FROM customer
    """
)
def blank_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are empty or all white space become NULL, others are trimmed."""
    cell = (
        F.when(F.col("c_custkey") % 4 == 0, F.lit(""))
        .when(F.col("c_custkey") % 4 == 1, F.lit(" \t\u00a0\n"))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" \t"), "c_name", F.lit("\u2003 ")))
        .otherwise(F.col("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", names.blank_to_null(cell).alias("name"))


# --- Audit and ingest ------------------------------------------------------


def _audit_state(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_state(derived.audit_events(spark, sf))


@query(
    """
    SELECT id, s3_bucket, s3_key, table_name, content_md5, bytes,
           strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at,
           duration_ms, rows_inserted, status, error_message, lambda_request_id, retry_count
    FROM v_audit
    """,
    "v_audit",
)
def audit_state(spark: SparkSession, sf: str) -> DataFrame:
    state = _audit_state(spark, sf)
    return state.withColumn("started_at", _time("started_at")).withColumn("finished_at", _time("finished_at"))


@query(
    """
    SELECT id AS audit_id, s3_key, table_name, status, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at,
           strftime(finished_at, '%Y-%m-%dT%H:%M:%S') AS finished_at, duration_ms, rows_inserted,
           CASE WHEN length(error_message) > 100 THEN left(error_message, 100) || '...' ELSE error_message END AS error_message
    FROM (SELECT * FROM v_audit ORDER BY v_audit.started_at DESC, id LIMIT 10)
    """,
    "v_audit",
)
def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    return audit.recent_audits(_audit_state(spark, sf))


@query(
    """
    SELECT id AS audit_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
           strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, s3_key AS key, status,
           coalesce(rows_inserted, 0) AS rows_inserted, left(coalesce(error_message, ''), 180) AS error
    FROM (SELECT * FROM v_audit ORDER BY v_audit.started_at DESC, id LIMIT 50)
    """,
    "v_audit",
)
def audit_browser(spark: SparkSession, sf: str) -> DataFrame:
    return audit.browse_audits(_audit_state(spark, sf))


@query(
    """
    SELECT c_custkey AS request_id, CAST(c_custkey * 11 AS VARCHAR) AS audit_id, s3_key,
           coalesce(status, 'not_found') AS status, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, rows_inserted, error_message
    FROM customer LEFT JOIN v_audit ON id = CAST(c_custkey * 11 AS VARCHAR)
    """,
    "v_audit",
)
def audit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 11).cast("string").alias("audit_id")
    )
    found = audit.audit_lookup(asked, _audit_state(spark, sf))
    return found.select("request_id", "audit_id", "s3_key", "status", "started_at", "rows_inserted", "error_message")


_SELECTED = """
    SELECT request_id, record_index, bucket, key,
           CASE WHEN record_index IS NULL THEN NULL WHEN bucket IS NULL THEN 'failed'
                WHEN NOT starts_with(lower(key), 'mba/csv/') OR NOT ends_with(lower(key), '.csv') THEN 'skipped' ELSE 'load' END AS status,
           CASE WHEN record_index IS NULL THEN NULL WHEN bucket IS NULL THEN 'Missing bucket or key in S3 record'
                WHEN NOT starts_with(lower(key), 'mba/csv/') THEN 'Not in mba/csv/ prefix'
                WHEN NOT ends_with(lower(key), '.csv') THEN 'Not a CSV file' END AS reason
    FROM v_records
"""


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return notices.select_records(notice_source.parse_notices(derived.notices(spark, sf)))


@query(f"SELECT request_id, CAST(record_index AS INTEGER) AS record_index, bucket, key, status, reason FROM ({_SELECTED})", "v_records")
def notice_records(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("request_id", "record_index", "bucket", "key", "status", "reason")


@query(
    f"""
    , r AS (SELECT request_id, CASE WHEN status <> 'load' THEN status WHEN (request_id + record_index) % 11 = 0 THEN 'failed'
                   WHEN status = 'load' THEN 'success' END AS status, request_id % 100 AS n FROM ({_SELECTED}))
    SELECT request_id, CAST(CASE WHEN count(status) = 0 THEN 400 WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 200 ELSE 207 END AS INTEGER) AS status_code,
           count(status) AS total_records, count(*) FILTER (WHERE status = 'success') AS files_processed, count(*) FILTER (WHERE status = 'failed') AS files_failed,
           count(*) FILTER (WHERE status = 'skipped') AS files_skipped,
           CAST(coalesce(sum(n) FILTER (status = 'success'), 0) AS BIGINT) AS total_rows_inserted,
           round(coalesce(count(*) FILTER (WHERE status = 'success') * 100.0::DOUBLE / nullif(count(status), 0), 0), 2) AS success_rate_percent,
           CASE WHEN count(status) = 0 THEN 'No S3 records found in event' END AS error
    FROM r GROUP BY request_id
    """,
    "v_records",
)
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Notices whose loads give a number of rows, or fail, by their number."""
    load = F.col("status") == "load"
    fails = (F.col("request_id") + F.col("record_index")) % 11 == 0
    status = F.when(load & fails, F.lit("failed")).when(load, F.lit("success")).otherwise(F.col("status"))
    done = _selected(spark, sf).select(
        "request_id", status.alias("status"), (F.col("request_id") % 100).alias("rows_inserted")
    )
    return notices.run_summary(done)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_counts({t: table(spark, sf, t) for t in TABLES})


# --- Benefits and balances -------------------------------------------------


_BENEFIT_REQUESTS = """
    , q AS (SELECT c_custkey AS request_id,
                   CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'M' || (1000 + c_custkey) END AS member_id,
                   CASE c_custkey % 7 WHEN 0 THEN 'Massage Therapy' WHEN 1 THEN 'Physical Therapy' WHEN 2 THEN 'Smoking Cessation'
                        WHEN 3 THEN 'Skilled Nursing Facility' WHEN 4 THEN 'Rehabilitation – Outpatient'
                        WHEN 5 THEN 'Invalid Service' ELSE '' END AS service
            FROM customer)
"""


@query(
    _BENEFIT_REQUESTS
    + """
    SELECT q.request_id, q.member_id, q.service,
           CASE WHEN q.member_id = '' OR q.service = '' THEN 'error' WHEN a.used IS NULL THEN 'not_found' ELSE 'success' END AS status,
           a.allowed_limit, a.used, a.remaining,
           CASE WHEN q.member_id = '' THEN 'member_id cannot be empty' WHEN q.service = '' THEN 'service cannot be empty'
                WHEN a.used IS NULL THEN 'No benefit accumulator data found for ' || q.member_id || ' - ' || q.service END AS message
    FROM q LEFT JOIN v_accum a ON a.member_id = q.member_id AND a.service = q.service
    """,
    "v_accum",
)
def benefit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return benefits.benefit_lookup(_benefit_requests(spark, sf), derived.accumulator(spark, sf))


def _benefit_requests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    services = [
        "Massage Therapy",
        " Physical Therapy ",
        "Smoking Cessation",
        "Skilled Nursing Facility",
        "Rehabilitation – Outpatient",
        "Invalid Service",
        "",
    ]
    return derived.members(spark, sf).select(
        n.alias("request_id"),
        F.when(n % 13 != 0, F.col("member_id")).alias("member_id"),
        derived._pick(n, *services).alias("service"),
    )


@query(
    _BENEFIT_REQUESTS
    + """
    , r AS (SELECT request_id, lower(member_id) AS member_id, upper(service) AS service FROM q)
    SELECT r.request_id, r.member_id, r.service,
           CASE WHEN r.member_id = '' OR r.service = '' THEN 'error' WHEN a.used IS NULL THEN 'not_found' ELSE 'success' END AS status,
           a.allowed_limit, a.used, a.remaining,
           CASE WHEN r.member_id = '' THEN 'member_id cannot be empty' WHEN r.service = '' THEN 'service cannot be empty'
                WHEN a.used IS NULL THEN 'No benefit accumulator data found for ' || r.member_id || ' - ' || r.service END AS message
    FROM r LEFT JOIN v_accum a ON lower(a.member_id) = r.member_id AND upper(a.service) = r.service
    """,
    "v_accum",
)
def benefit_lookup_any_case(spark: SparkSession, sf: str) -> DataFrame:
    asked = _benefit_requests(spark, sf).withColumns({"member_id": F.lower("member_id"), "service": F.upper("service")})
    return benefits.benefit_lookup(asked, derived.accumulator(spark, sf), any_case=True)


@query(
    """
    SELECT member_id, CAST(CASE service WHEN 'Massage Therapy' THEN 1 WHEN 'Physical Therapy' THEN 2
                WHEN 'Skilled Nursing Facility' THEN 4 WHEN 'Smoking Cessation' THEN 5 ELSE 6 END AS INTEGER) AS ordinal,
           service, allowed_limit, used, remaining
    FROM v_accum
    """,
    "v_accum",
)
def benefit_all(spark: SparkSession, sf: str) -> DataFrame:
    return benefits.all_benefits(derived.accumulator(spark, sf))


@query(
    "SELECT member_id, service, allowed_limit, used, remaining FROM v_accum WHERE member_id = 'M1019' AND service = 'Massage Therapy'",
    "v_accum",
)
def benefit_routine(spark: SparkSession, sf: str) -> DataFrame:
    routines = tables.Routines()
    rows = derived.accumulator(spark, sf)
    routines.register("GetBenefitAccumulator", lambda m, s, year: benefits.benefit_rows(rows, m, s))
    return routines.call("GetBenefitAccumulator", ["M1019", "Massage Therapy", 2025])


def _as_double(df: DataFrame) -> DataFrame:
    """Money to double at the edge, where results are compared."""
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


@query("SELECT * FROM v_balances", "v_balances")
def deductible_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _as_double(deductibles.flat_balances(derived.deductibles(spark, sf)))


_LAST = """
    , k AS (SELECT *, row_number() OVER (PARTITION BY member_id, plan_year, kind, level, network
                                         ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, lim DESC) AS r FROM v_lines)
    SELECT member_id, plan_year,
"""


@query(
    _LAST
    + ", ".join(
        f"CAST(coalesce(sum({a}) FILTER (r = 1 AND kind = '{k}' AND level = '{lv}' AND network = '{n}'), 0) AS DOUBLE) AS {name}_{b}"
        for name, (k, lv, n) in deductibles.CELLS.items()
        for a, b in (("lim", "limit"), ("used", "used"), ("lim - used", "remaining"))
    )
    + " FROM k GROUP BY member_id, plan_year",
    "v_lines",
)
def deductible_last_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Balances from single entries: of those for one cell the last stands."""
    entries = derived.balance_entries(spark, sf)
    # The fields that order entries, as one number of fixed width.
    widths = {"l_orderkey": 12, "l_linenumber": 2, "l_partkey": 9, "l_suppkey": 7}
    fields = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in widths.items()]
    cents = F.lpad((F.col("limit_amount").cast("decimal(18,2)") * 100).cast("long").cast("string"), 8, "0")
    order = F.concat(*fields, cents).cast("decimal(38,0)")
    return _as_double(deductibles.flat_balances(entries, order))


_BALANCE_REQUESTS = """
    , q AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'M' || (1000 + c_custkey) END AS member_id,
                   CAST(2019 + c_custkey % 9 AS INTEGER) AS plan_year,
                   CASE c_custkey % 3 WHEN 0 THEN 'in_network' WHEN 1 THEN 'out_of_network' ELSE 'in-network' END AS network_type,
                   CASE c_custkey % 4 WHEN 0 THEN 'individual' WHEN 3 THEN 'group' ELSE 'family' END AS coverage_level
            FROM customer)
"""


def _balance_requests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    return derived.members(spark, sf).select(
        n.alias("request_id"),
        F.when(n % 17 != 0, F.col("member_id")).otherwise(F.lit("  ")).alias("member_id"),
        (n % 9 + 2019).cast("int").alias("plan_year"),
        derived._pick(n, "in_network", "out_of_network", "in-network").alias("network_type"),
        derived._pick(n, "individual", "family", "family", "group").alias("coverage_level"),
    )


_STATUS = """
    CASE WHEN {bad} q.member_id = '' OR q.plan_year NOT BETWEEN 2020 AND 2030 THEN 'error'
         WHEN b.member_id IS NULL THEN 'not_found' ELSE 'success' END AS status,
    CASE {text} WHEN q.member_id = '' THEN 'member_id cannot be empty'
         WHEN q.plan_year NOT BETWEEN 2020 AND 2030 THEN 'plan_year must be a valid integer between 2020 and 2030'
         WHEN b.member_id IS NULL THEN 'No deductible/OOP data found for member ' || q.member_id || ' in plan year ' || q.plan_year END AS message
"""
_PLAIN_STATUS = _STATUS.format(bad="", text="")


@query(
    _BALANCE_REQUESTS
    + f"SELECT q.request_id, q.member_id, q.plan_year, {_PLAIN_STATUS}, "
    + ", ".join(
        f"CASE WHEN q.plan_year BETWEEN 2020 AND 2030 THEN b.{c}_{a} END AS {c}_{a}"
        for c in deductibles.CELLS
        for a in deductibles.AMOUNTS
    )
    + " FROM q LEFT JOIN v_balances b ON b.member_id = q.member_id AND b.plan_year = q.plan_year",
    "v_balances",
)
def deductible_lookup(spark: SparkSession, sf: str) -> DataFrame:
    balances = deductibles.flat_balances(derived.deductibles(spark, sf))
    return _as_double(deductibles.balance_lookup(_balance_requests(spark, sf), balances))


def _cell_sql(kind: str, level: str | None) -> str:
    level_sql = f"'{level}'" if level else "q.coverage_level"
    bad = "q.network_type = 'in-network' OR"
    text = "WHEN q.network_type = 'in-network' THEN 'network_type must be ''in_network'' or ''out_of_network'''"
    if not level:
        bad = f"q.coverage_level = 'group' OR {bad}"
        text = f"WHEN q.coverage_level = 'group' THEN 'coverage_level must be ''individual'' or ''family''' {text}"
    prefix = "ded" if kind == "deductible" else "oop"
    amounts = ", ".join(
        "CASE "
        + " ".join(
            f"WHEN s.status = 'success' AND s.coverage_level = '{lv}' AND s.network_type = '{n}' THEN s.{prefix}_{lv}_{n}_{a}"
            for lv in deductibles.LEVELS
            for n in deductibles.NETWORKS
        )
        + f" END AS {a}"
        for a in deductibles.AMOUNTS
    )
    return (
        _BALANCE_REQUESTS
        + f", s AS (SELECT q.request_id, q.member_id, q.plan_year, {level_sql} AS coverage_level, q.network_type,"
        + _STATUS.format(bad=bad, text=text)
        + ", b.* EXCLUDE (member_id, plan_year) FROM q LEFT JOIN v_balances b ON b.member_id = q.member_id AND b.plan_year = q.plan_year)"
        + f" SELECT request_id, member_id, plan_year, coverage_level, network_type, status, message, {amounts} FROM s"
    )


@query(_cell_sql("deductible", "individual"), "v_balances")
def deductible_individual(spark: SparkSession, sf: str) -> DataFrame:
    balances = deductibles.flat_balances(derived.deductibles(spark, sf))
    return _as_double(deductibles.individual_deductible(_balance_requests(spark, sf), balances))


@query(_cell_sql("deductible", "family"), "v_balances")
def deductible_family(spark: SparkSession, sf: str) -> DataFrame:
    balances = deductibles.flat_balances(derived.deductibles(spark, sf))
    return _as_double(deductibles.family_deductible(_balance_requests(spark, sf), balances))


@query(_cell_sql("out_of_pocket", None), "v_balances")
def oop_maximum(spark: SparkSession, sf: str) -> DataFrame:
    balances = deductibles.flat_balances(derived.deductibles(spark, sf))
    return _as_double(deductibles.out_of_pocket_maximum(_balance_requests(spark, sf), balances))


@query(
    """
    SELECT member_id, t.* FROM v_members, (VALUES
      ('deductible', 'individual', 'in_network', 1500.0::DOUBLE, 350.0::DOUBLE, 1150.0::DOUBLE),
      ('deductible', 'individual', 'out_of_network', 3000.0, 0.0, 3000.0),
      ('deductible', 'family', 'in_network', 3000.0, 750.0, 2250.0),
      ('deductible', 'family', 'out_of_network', 6000.0, 0.0, 6000.0),
      ('out_of_pocket', 'individual', 'in_network', 5000.0, 1200.0, 3800.0),
      ('out_of_pocket', 'individual', 'out_of_network', 10000.0, 0.0, 10000.0),
      ('out_of_pocket', 'family', 'in_network', 10000.0, 2400.0, 7600.0),
      ('out_of_pocket', 'family', 'out_of_network', 20000.0, 0.0, 20000.0))
      t(deductible_type, coverage_level, network_type, limit_amount, used_amount, remaining_amount)
    WHERE member_id = 'M1001'
    """,
    "v_members",
)
def deductible_literal(spark: SparkSession, sf: str) -> DataFrame:
    return _as_double(deductibles.routine_balances(derived.members(spark, sf).select("member_id")))


# --- Verification and questions --------------------------------------------


@query(
    """
    , k AS (SELECT r.request_id, min(m.member_id) AS member_id
            FROM v_requests r JOIN v_members m ON m.member_id = r.member_id AND CAST(m.dob AS VARCHAR) = r.dob GROUP BY 1
            UNION ALL
            SELECT r.request_id, min(m.member_id) FROM v_requests r JOIN v_members m ON m.member_id = r.member_id
            WHERE coalesce(r.dob, '') = '' GROUP BY 1
            UNION ALL
            SELECT r.request_id, min(m.member_id) FROM v_requests r JOIN v_members m ON CAST(m.dob AS VARCHAR) = r.dob
            WHERE coalesce(r.member_id, '') = '' GROUP BY 1)
    SELECT r.request_id, k.member_id IS NOT NULL AS valid, m.member_id, m.name, CAST(m.dob AS VARCHAR) AS dob,
           CASE WHEN coalesce(r.member_id, '') = '' AND coalesce(r.dob, '') = '' THEN 'At least one identifier required'
                WHEN k.member_id IS NULL THEN 'Authentication failed' END AS message
    FROM v_requests r LEFT JOIN k USING (request_id) LEFT JOIN v_members m ON m.member_id = k.member_id
    """,
    "v_requests",
)
def verify_requests(spark: SparkSession, sf: str) -> DataFrame:
    return members.verify_members(derived.verify_requests(spark, sf), derived.members(spark, sf))


@query(
    """
    SELECT request_id, CASE WHEN hit THEN member_id END AS member_id, CASE WHEN hit THEN name END AS name,
           CASE WHEN hit THEN dob END AS date_of_birth, CASE WHEN hit THEN 'verified' ELSE 'invalid' END AS status
    FROM (SELECT r.request_id, r.member_id, r.dob, m.name, m.member_id IS NOT NULL AS hit,
                 r.member_name IS NOT NULL AND EXISTS (SELECT 1 FROM v_members x WHERE CAST(x.dob AS VARCHAR) = r.dob
                        AND x.name LIKE '%' || r.member_name || '%') AS by_name
          FROM v_requests r LEFT JOIN v_members m ON m.member_id = r.member_id AND CAST(m.dob AS VARCHAR) = r.dob)
    WHERE hit OR NOT by_name
    """,
    "v_requests",
)
def verify_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return members.verify_in_two_stages(derived.verify_requests(spark, sf), derived.members(spark, sf))


@query(
    """
    SELECT request_id, CASE WHEN hit THEN lower(member_id) END AS member_id, CASE WHEN hit THEN name END AS name,
           CASE WHEN hit THEN dob END AS date_of_birth, CASE WHEN hit THEN 'verified' ELSE 'invalid' END AS status
    FROM (SELECT r.request_id, r.member_id, r.dob, m.name, m.member_id IS NOT NULL AS hit,
                 r.member_name IS NOT NULL AND EXISTS (SELECT 1 FROM v_members x WHERE CAST(x.dob AS VARCHAR) = r.dob
                        AND lower(x.name) LIKE '%' || lower(r.member_name) || '%') AS by_name
          FROM v_requests r LEFT JOIN v_members m ON lower(m.member_id) = lower(r.member_id) AND CAST(m.dob AS VARCHAR) = r.dob)
    WHERE hit OR NOT by_name
    """,
    "v_requests",
)
def verify_two_stage_any_case(spark: SparkSession, sf: str) -> DataFrame:
    asked = derived.verify_requests(spark, sf).withColumns(
        {"member_id": F.lower("member_id"), "member_name": F.upper("member_name")}
    )
    return members.verify_in_two_stages(asked, derived.members(spark, sf), any_case=True)


# Fixed values below: the patterns and words of the question rules.
_INTENTS = r"""
    , t AS (SELECT question_id, question, trim(question) AS q, lower(trim(question)) AS l FROM v_questions),
    i AS (SELECT question_id, question,
        CASE WHEN regexp_matches(l, 'verify|validate|check identity|confirm') THEN 'verify_member'
             WHEN regexp_matches(l, 'deductible|out-of-pocket|oop|maximum') THEN 'get_deductible_oop'
             WHEN regexp_matches(l, 'benefit|remaining|usage|accumulator|balance') THEN 'get_benefit_accumulator'
             ELSE 'verify_member' END AS intent,
        coalesce(nullif(regexp_extract(q, 'member[_\s]*id[=:\s]*([A-Z0-9]+)', 1, 'i'), ''), nullif(regexp_extract(q, '\bM\d{4}\b'), '')) AS member_id,
        CAST(NULL AS VARCHAR) AS name,
        coalesce(nullif(regexp_extract(q, 'dob[=:\s]*(\d{4}-\d{2}-\d{2})', 1, 'i'), ''), nullif(regexp_extract(q, '\b\d{4}-\d{2}-\d{2}\b'), '')) AS dob,
        CASE WHEN contains(l, 'massage therapy') THEN 'Massage Therapy' WHEN contains(l, 'physical therapy') THEN 'Physical Therapy'
             WHEN contains(l, 'chiropractic') THEN 'Chiropractic' WHEN contains(l, 'acupuncture') THEN 'Acupuncture' END AS service,
        CAST(coalesce(nullif(regexp_extract(q, '\b(20\d{2})\b', 1), ''), '2025') AS INTEGER) AS plan_year,
        nullif(regexp_extract(q, 'plan[_\s]*(?:name|id)[=:\s]*([A-Z0-9]+)', 1, 'i'), '') AS plan_name,
        nullif(regexp_extract(q, 'group[_\s]*(?:number|id)[=:\s]*(\d+)', 1, 'i'), '') AS group_number
      FROM t)
"""


@query(_INTENTS + "SELECT * FROM i", "v_questions")
def question_intents(spark: SparkSession, sf: str) -> DataFrame:
    return questions.question_intents(derived.questions(spark, sf))


@query(
    _INTENTS
    + """SELECT question_id, CASE WHEN trim(question) = '' THEN 'verify_member' ELSE intent END AS intent, member_id, name, dob, service,
                CASE WHEN trim(question) <> '' THEN plan_year END AS plan_year, plan_name, group_number,
                trim(question) = '' AS error, CASE WHEN trim(question) = '' THEN 'Query cannot be empty' END AS error_text FROM i""",
    "v_questions",
)
def question_batch(spark: SparkSession, sf: str) -> DataFrame:
    done = questions.question_batch(derived.questions(spark, sf))
    return done.select("question_id", "intent", "params.*", "error", "error_text")


# Fixed values below: the words and lines of the summary rules.
_SUMMARY = r"""
    , p AS (SELECT i.*, coalesce(m.member_id, d.member_id) AS found,
                   regexp_matches(lower(question), 'complete|everything|all|show me') AS wants
            FROM i LEFT JOIN v_members m ON m.member_id = i.member_id AND (i.dob IS NULL OR CAST(m.dob AS VARCHAR) = i.dob)
                   LEFT JOIN (SELECT dob, min(member_id) AS member_id FROM v_members GROUP BY dob) d
                          ON i.member_id IS NULL AND CAST(d.dob AS VARCHAR) = i.dob),
    b AS (SELECT member_id, string_agg('  ' || service || ': ' || used || ' used, ' || remaining || ' remaining (Limit: ' || allowed_limit || ')', chr(10)
                 ORDER BY CASE service WHEN 'Massage Therapy' THEN 1 WHEN 'Physical Therapy' THEN 2 WHEN 'Skilled Nursing Facility' THEN 4
                               WHEN 'Smoking Cessation' THEN 5 ELSE 6 END) AS text FROM v_accum GROUP BY member_id),
    o AS (SELECT member_id, '  Deductible IND (In-Network): $' || format('{:.0f}', ded_individual_in_network_remaining) || ' remaining' || chr(10)
              || '  Deductible FAM (In-Network): $' || format('{:.0f}', ded_family_in_network_remaining) || ' remaining' || chr(10)
              || '  OOP IND (In-Network): $' || format('{:.0f}', oop_individual_in_network_remaining) || ' remaining' || chr(10)
              || '  OOP FAM (In-Network): $' || format('{:.0f}', oop_family_in_network_remaining) || ' remaining' AS text
          FROM v_balances WHERE plan_year = 2025),
    s AS (SELECT p.question_id, p.question,
            CASE WHEN trim(p.question) = '' THEN 'Query cannot be empty'
                 WHEN coalesce(p.member_id, p.dob, p.plan_name, p.group_number) IS NULL
                      THEN 'member_id or dob required (plan_name/group_number not available in current schema)'
                 WHEN found IS NULL THEN 'Member verification failed' END AS error,
            CASE WHEN wants THEN '🧾 Member ID: ' || m.member_id || ' (DOB: ' || CAST(m.dob AS VARCHAR) || ')' || chr(10) || chr(10)
                   || 'Name: ' || m.name || chr(10) || chr(10)
                   || coalesce('🏥 Benefits' || chr(10) || b.text || chr(10), '')
                   || coalesce(chr(10) || '💰 Deductibles / OOP Summary' || chr(10) || o.text || chr(10), '')
                   || chr(10) || '🧩 Plan Info' || chr(10) || '  Member verified in system'
                 ELSE 'Query processed' END AS summary
          FROM p LEFT JOIN v_members m ON m.member_id = found LEFT JOIN b ON b.member_id = found LEFT JOIN o ON o.member_id = found)
    SELECT question_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status,
           CASE WHEN error IS NULL THEN summary END AS summary, error,
           CASE WHEN question = '' THEN 'Please provide a query to process.'
                WHEN error IS NOT NULL THEN 'I encountered an issue: ' || error ELSE summary END AS reply
    FROM s
"""


@query(_INTENTS + _SUMMARY, "v_questions", "v_accum", "v_balances")
def member_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary.answer_questions(
        derived.questions(spark, sf),
        derived.members(spark, sf),
        derived.accumulator(spark, sf),
        derived.deductibles(spark, sf),
    )
