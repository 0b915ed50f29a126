"""Domain inputs derived from the driver tables, whole tables each time.

`VIEWS` states the same derivations in SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import audit

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

ROOT = "/data"
FIRST_DAY = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column | str, *choices: Column | str) -> Column:
    """One of the choices by ``number`` modulo their count."""
    number = F.col(number) if isinstance(number, str) else number
    out = None
    for i, c in enumerate(choices):
        value = F.lit(c) if isinstance(c, str) else c
        test = number % len(choices) == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _minutes_after(start: str, minutes: str) -> Column:
    return F.expr(f"{start} + make_dt_interval(0, 0, cast({minutes} as int), 0)")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, size, modified, content."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), _pick("doc_id", ".csv", ".pdf", ".TXT", ".docx", "", ".json"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(f"{ROOT}/"), _pick("doc_id", "mba", "policy", "misc"), F.lit("/"), "source", F.lit("/"), name).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        _minutes_after(FIRST_DAY, "(doc_id * 7919) % 100000").alias("modified"),
        F.col("text").cast("binary").alias("content"),
    )


def remote(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Documents as an object listing: ``every`` one, or those with an even
    number, so that a comparison with it finds files that are missing."""
    base = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    name = F.concat(base, _pick("doc_id", ".csv", ".pdf", ".TXT", ".docx", "", ".json"))
    shown = F.when(F.col("doc_id") % 8 == 0, F.upper(name)).otherwise(name)
    scope = _pick("doc_id", "mba", "policy", "mba")
    category = _pick("doc_id", "csv", "pdf", "text", "docx", "other", "json")
    return (
        table(spark, sf_dir, "documents")
        .where("true" if every else "doc_id % 2 = 0")
        .select(
            F.concat(scope, F.lit("-bucket")).alias("bucket"),
            F.concat(scope, F.lit("/"), category, F.lit("/"), shown).alias("key"),
            (F.octet_length("text") + F.when(F.col("doc_id") % 10 == 0, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("size"),
            _minutes_after(FIRST_DAY, "doc_id % 100000 + 1440").alias("last_modified"),
            F.concat(F.lit('"'), F.md5("text"), F.lit('"')).alias("etag"),
        )
    )


def upload_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upload results: path, success, message, size, ts."""
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    key = F.concat(F.lit("mba/csv/e_"), number, F.lit(".csv"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit(f"{ROOT}/"), _pick("event_id", "mba", "policy", "misc"), F.lit("/e_"), number, F.lit(".csv")).alias("path"),
        (kind != "error").alias("success"),
        F.when(kind == "error", F.lit("Error: timed out"))
        .when(kind == "click", F.concat(F.lit("Skipped - already in S3: "), key))
        .otherwise(F.concat(F.lit("Uploaded to s3://mba-bucket/"), key))
        .alias("message"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        "ts",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: job, state, ts, seq, worker."""
    state = (
        F.when(F.col("event_type") == "purchase", F.lit("processed"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("queued"))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job_"), (F.col("user_id") * 100 + F.col("event_id") % 10).cast("string")).alias("job"),
        state.alias("state"),
        "ts",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("worker_"), (F.col("user_id") % 4).cast("string")).alias("worker"),
    )


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as object-created notices in JSON, four records each; every
    twentieth has none."""
    page = F.col("page_id")
    number = page.cast("string")

    def record(i: Column) -> Column:
        n = page + i
        key = _pick(
            n,
            F.concat(F.lit("mba/csv/"), number, F.lit(".csv")),
            F.concat(F.lit("MBA/CSV/"), number, F.lit(".CSV")),
            F.concat(F.lit("policy/csv/"), number, F.lit(".csv")),
            F.concat(F.lit("mba/csv/"), number, F.lit(".pdf")),
        )
        bucket = F.when(n % 25 != 0, F.lit("mba-bucket"))
        return F.struct(
            F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3")
        )

    records = F.transform(F.sequence(F.lit(0), F.lit(3)), record)
    body = F.to_json(F.struct(F.when(page % 20 != 7, records).otherwise(F.slice(records, 1, 0)).alias("Records")))
    return table(spark, sf_dir, "pages").select(page.alias("request_id"), body.alias("body"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        _member("c_custkey").alias("member_id"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        _birthday("c_custkey").alias("dob"),
    )


def _member(key: str) -> Column:
    return F.concat(F.lit("M"), (F.col(key) + 1000).cast("string"))


def _birthday(key: str) -> Column:
    return F.date_add(F.lit("1950-01-01").cast("date"), (F.col(key) * 37 % 20000).cast("int"))


ACCUMULATED = {
    "1-URGENT": "Massage Therapy",
    "2-HIGH": "Physical Therapy",
    "3-MEDIUM": "Skilled Nursing Facility",
    "4-NOT SPECIFIED": "Smoking Cessation",
    "5-LOW": "Rehabilitation – Outpatient",
}


def accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benefit usage: one row per member and service."""
    service = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(s)) for p, s in ACCUMULATED.items()])
    used = F.count("*").cast("int")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(_member("o_custkey").alias("member_id"), service.alias("service"))
        .agg(
            F.lit("30 visit calendar year maximum").alias("allowed_limit"),
            used.alias("used"),
            F.greatest(F.lit(30) - used, F.lit(0)).alias("remaining"),
        )
    )


def balance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as balance entries, one row each, amounts in whole cents."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    price, percent = (F.round(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_discount"))
    status = F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _member("o_custkey").alias("member_id"),
            (F.year("o_orderdate") + 25).alias("plan_year"),
            F.when(F.col("l_linestatus") == "F", F.lit("deductible")).otherwise(F.lit("out_of_pocket")).alias("deductible_type"),
            F.when(F.col("l_returnflag") == "A", F.lit("Individual"))
            .when(F.col("l_returnflag") == "N", F.lit("family"))
            .otherwise(F.lit("group"))
            .alias("coverage_level"),
            F.when(status == "F", F.lit("in-network"))
            .when(status == "O", F.lit("Out_Of_Network"))
            .otherwise(F.lit("unknown"))
            .alias("network_type"),
            price.alias("limit_cents"),
            F.floor((price * percent + 50) / 100).alias("used_cents"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
        )
    )


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def balance_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`balance_lines` as rows of the balance table."""
    return with_amounts(balance_lines(spark, sf_dir))


def with_amounts(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[c for c in rows.columns if not c.endswith("_cents")],
        _money(F.col("limit_cents")).alias("limit_amount"),
        _money(F.col("used_cents")).alias("used_amount"),
        _money(F.lit(0)).alias("remaining_amount"),
    )


def deductibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`balance_lines` summed: one row per member, year and cell."""
    keys = ["member_id", "plan_year", "deductible_type", "coverage_level", "network_type"]
    cents = [F.sum(c).alias(c) for c in ("limit_cents", "used_cents")]
    return with_amounts(balance_lines(spark, sf_dir).groupBy(*keys).agg(*cents))


QUESTIONS = (
    "What's my deductible for member {id}?",
    "Show me all my information member_id={id} dob={dob}",
    "Verify my identity, DOB {dob}",
    "Give me complete details for member_id={id} dob={dob}",
    "What are my benefits for member_id={id}",
    "Show deductible for plan_name=020213CA",
    "How much Massage Therapy benefit remaining? member_id={id} dob={dob}",
    "Show everything for dob={dob}",
    "Get benefits for group_number=20213",
    "Verify member identity",
    "my loop is open for 2024",
    "  ",
    "Show all benefits for member_id={id} dob=1900-01-01",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each customer, from the templates above."""
    m = members(spark, sf_dir)
    filled = [
        F.replace(F.replace(F.lit(q), F.lit("{id}"), F.col("member_id")), F.lit("{dob}"), F.col("dob").cast("string"))
        for q in QUESTIONS
    ]
    return m.select(F.col("c_custkey").alias("question_id"), _pick("c_custkey", *filled).alias("question"))


def verify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verification request of each customer: both identifiers, a wrong
    date, either one, none, or a wrong id with part of the name."""
    m = members(spark, sf_dir)
    n, dob = F.col("c_custkey"), F.col("dob").cast("string")
    null = F.lit(None).cast("string")
    member = F.col("member_id")
    return m.select(
        n.alias("request_id"),
        _pick(n, member, member, member, null, F.lit(""), F.lit("M0"), F.lit("M0")).alias("member_id"),
        _pick(n, dob, F.lit("1990-01-01"), null, dob, null, dob, dob).alias("dob"),
        _pick(n, null, F.substring_index("last_name", "#", -1), null, null, null, F.substring_index("last_name", "#", -1), F.lit("_ustomer%9")).alias("member_name"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audit events: each starts; some finish, some fail."""
    number = F.col("o_orderkey").cast("string")
    start = F.col("o_orderdate")
    end = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_custkey % 90 + 1 as int), 0)")
    base = {
        "id": number,
        "s3_bucket": F.lit("mba-bucket"),
        "s3_key": F.concat(F.lit("mba/csv/o_"), number, F.lit(".csv")),
        "table_name": F.concat(F.lit("o_"), number),
        "content_md5": F.md5(number),
        "bytes": F.col("o_totalprice").cast("long"),
        "lambda_request_id": F.concat(F.lit("r"), (F.col("o_custkey")).cast("string")),
    }
    fields = [f.strip().split(" ") for f in audit.EVENT_SCHEMA.split(",")]

    def event(values: dict[str, Column]) -> Column:
        return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])

    status = F.col("o_orderstatus")
    finish = event(
        {
            "id": number,
            "event": F.when(status == "F", F.lit("SUCCESS")).otherwise(F.lit("FAILED")),
            "ts": end,
            "duration_ms": F.when(status == "F", (F.col("o_custkey") % 90 + 1) * 60000),
            "rows_inserted": F.when(status == "F", F.col("o_totalprice").cast("long")),
            "error_message": F.when(status == "P", F.repeat(F.concat(F.lit("bad row "), number, F.lit("; ")), 20)),
            "retry_count": F.when(status == "P", F.col("o_custkey") % 3),
        }
    )
    begin = event({**base, "event": F.lit("STARTED"), "ts": start})
    both = F.when(status == "O", F.array(begin)).otherwise(F.array(begin, finish))
    return table(spark, sf_dir, "orders").select(F.inline(both))


def csv_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three tables as the text columns of three CSV files, by file name."""

    def blank(test: str, value: Column) -> Column:
        return F.when(F.expr(test), F.lit("  ")).otherwise(value)

    o, when = F.col, "o_orderdate"
    three = _pick(
        "o_orderkey",
        F.date_format(when, "yyyy-MM-dd"),
        F.date_format(when, "d-M-yyyy"),
        F.date_format(when, "M/d/yyyy"),
    )
    key = o("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders").select(
        key.alias("Order Key"),
        blank("o_orderkey % 7 = 0", o("o_custkey").cast("string")).alias("Customer-Key"),
        three.alias("Order Date"),
        blank("o_orderkey % 5 = 0", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")).alias("Loaded At"),
        o("o_orderpriority").alias("1st Priority"),
        F.concat(F.lit(" "), o("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")).alias("Total"),
        _pick("o_orderkey", "yes", "N", "true").alias("open?"),
        blank("o_orderkey % 11 = 0", _pick("o_orderkey", "yes", "no")).alias("Paid"),
        (o("o_orderkey") % 2).cast("string").alias("Flag"),
        F.lit("").alias("__"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("Part Key"),
        F.col("p_brand").alias("Brand"),
        F.col("p_type").alias("P Type"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("1_000")).otherwise(F.col("p_size").cast("string")).alias("p.size"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("nan")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("e-2"))).alias("Ratio"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-29")).alias("Bad Date"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("Cust Key"),
        F.col("c_name").alias("Name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("Segment"),
    )
    return {"orders.csv": orders, "part.csv": part, "customer.csv": customer}


def _sql_pick(number: str, *choices: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE ({number}) % {len(choices)} {cases} END"


def _quoted(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


_EXT = _sql_pick("doc_id", *_quoted(".csv", ".pdf", ".TXT", ".docx", "", ".json"))
_DIR = _sql_pick("doc_id", *_quoted("mba", "policy", "misc"))
_SCOPE = _sql_pick("doc_id", *_quoted("mba", "policy", "mba"))
_CATEGORY = _sql_pick("doc_id", *_quoted("csv", "pdf", "text", "docx", "other", "json"))
_ACCUMULATED = " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in ACCUMULATED.items())
_QUESTION = _sql_pick(
    "c_custkey",
    *[f"replace(replace({q}, '{{id}}', member_id), '{{dob}}', CAST(dob AS VARCHAR))" for q in _quoted(*QUESTIONS)],
)

# SQL of the derivations, in an order in which each can use those before it.
VIEWS = {
    "v_files": f"""
        SELECT doc_id, '{ROOT}/' || {_DIR} || '/' || source || '/doc_' || doc_id || {_EXT} AS path,
               'doc_' || doc_id || {_EXT} AS name,
               {_DIR} AS dir, lower({_EXT}) AS ext, {_CATEGORY} AS category,
               CAST(strlen(text) AS BIGINT) AS size, md5(text) AS hash,
               TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 100000) AS modified
        FROM documents""",
    "v_listing": f"""
        SELECT {_SCOPE} || '-bucket' AS bucket,
               {_SCOPE} || '/' || {_CATEGORY} || '/'
                 || CASE WHEN doc_id % 8 = 0 THEN upper('doc_' || doc_id || {_EXT}) ELSE 'doc_' || doc_id || {_EXT} END AS key,
               CASE WHEN doc_id % 8 = 0 THEN upper('doc_' || doc_id || {_EXT}) ELSE 'doc_' || doc_id || {_EXT} END AS name,
               lower({_EXT}) AS ext,
               CAST(strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size,
               TIMESTAMP '2024-01-01' + to_minutes(doc_id % 100000 + 1440) AS last_modified,
               md5(text) AS etag
        FROM documents""",
    "v_remote": "SELECT * FROM v_listing WHERE CAST(regexp_extract(name, '[0-9]+') AS BIGINT) % 2 = 0",
    "v_history": f"""
        SELECT event_id, '{ROOT}/' || {_sql_pick("event_id", *_quoted("mba", "policy", "misc"))} || '/e_' || event_id || '.csv' AS file_path,
               {_sql_pick("event_id", *_quoted("mba", "policy", "unknown"))} AS scope,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'success' END AS status,
               CASE event_type WHEN 'error' THEN 'Error: timed out'
                    WHEN 'click' THEN 'Skipped - already in S3: mba/csv/e_' || event_id || '.csv'
                    ELSE 'Uploaded to s3://mba-bucket/mba/csv/e_' || event_id || '.csv' END AS message,
               CASE WHEN event_type IN ('error', 'click') THEN '' ELSE 'mba-bucket/mba/csv/e_' || event_id || '.csv' END AS s3_key,
               CAST(round(value * 100) AS BIGINT) AS size, ts
        FROM events""",
    "v_jobs": """
        SELECT 'job_' || (user_id * 100 + event_id % 10) AS job,
               CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS state,
               ts, event_id AS seq, 'worker_' || (user_id % 4) AS worker
        FROM events""",
    "v_records": f"""
        SELECT page_id AS request_id, i AS record_index,
               CASE WHEN (page_id + i) % 25 <> 0 THEN 'mba-bucket' END AS bucket,
               {_sql_pick("page_id + i", "'mba/csv/' || page_id || '.csv'", "'MBA/CSV/' || page_id || '.CSV'", "'policy/csv/' || page_id || '.csv'", "'mba/csv/' || page_id || '.pdf'")} AS key
        FROM pages, range(4) r(i) WHERE page_id % 20 <> 7
        UNION ALL SELECT page_id, NULL, NULL, NULL FROM pages WHERE page_id % 20 = 7""",
    "v_members": """
        SELECT c_custkey, 'M' || (1000 + c_custkey) AS member_id, c_mktsegment AS first_name, c_name AS last_name,
               c_mktsegment || ' ' || c_name AS name,
               DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS dob
        FROM customer""",
    "v_accum": f"""
        SELECT 'M' || (1000 + o_custkey) AS member_id, CASE o_orderpriority {_ACCUMULATED} END AS service,
               '30 visit calendar year maximum' AS allowed_limit,
               CAST(count(*) AS INTEGER) AS used, CAST(greatest(30 - count(*), 0) AS INTEGER) AS remaining
        FROM orders GROUP BY o_custkey, o_orderpriority""",
    "v_lines": """
        SELECT 'M' || (1000 + o_custkey) AS member_id, CAST(year(o_orderdate) + 25 AS INTEGER) AS plan_year,
               CASE l_linestatus WHEN 'F' THEN 'deductible' ELSE 'out_of_pocket' END AS kind,
               CASE l_returnflag WHEN 'A' THEN 'individual' WHEN 'N' THEN 'family' ELSE 'group' END AS level,
               CASE o_orderstatus WHEN 'F' THEN 'in_network' WHEN 'O' THEN 'out_of_network' ELSE 'unknown' END AS network,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS lim,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS used,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_cellsum": """
        SELECT member_id, plan_year, kind, level, network, sum(lim) AS lim, sum(used) AS used
        FROM v_lines GROUP BY ALL""",
    "v_balances": """
        SELECT member_id, plan_year, """
    + ", ".join(
        f"CAST(coalesce(sum({a}) FILTER (kind = '{k}' AND level = '{lv}' AND network = '{n}'), 0) AS DOUBLE) AS {'ded' if k == 'deductible' else 'oop'}_{lv}_{n}_{b}"
        for k in ("deductible", "out_of_pocket")
        for lv in ("individual", "family")
        for n in ("in_network", "out_of_network")
        for a, b in (("lim", "limit"), ("used", "used"), ("lim - used", "remaining"))
    )
    + " FROM v_cellsum GROUP BY member_id, plan_year",
    "v_questions": f"SELECT c_custkey AS question_id, {_QUESTION} AS question FROM v_members",
    "v_requests": f"""
        SELECT c_custkey AS request_id,
               {_sql_pick("c_custkey", "member_id", "member_id", "member_id", "NULL", "''", "'M0'", "'M0'")} AS member_id,
               {_sql_pick("c_custkey", "CAST(dob AS VARCHAR)", "'1990-01-01'", "NULL", "CAST(dob AS VARCHAR)", "NULL", "CAST(dob AS VARCHAR)", "CAST(dob AS VARCHAR)")} AS dob,
               {_sql_pick("c_custkey", "NULL", "split_part(last_name, '#', 2)", "NULL", "NULL", "NULL", "split_part(last_name, '#', 2)", "'_ustomer%9'")} AS member_name
        FROM v_members""",
    "v_audit": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'mba-bucket' AS s3_bucket, 'mba/csv/o_' || o_orderkey || '.csv' AS s3_key,
               'o_' || o_orderkey AS table_name, md5(CAST(o_orderkey AS VARCHAR)) AS content_md5,
               CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS started_at,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_custkey % 90 + 1) END AS finished_at,
               CASE WHEN o_orderstatus = 'F' THEN CAST((o_custkey % 90 + 1) * 60000 AS INTEGER) END AS duration_ms,
               CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS rows_inserted,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'STARTED' ELSE 'FAILED' END AS status,
               CASE WHEN o_orderstatus = 'P' THEN repeat('bad row ' || o_orderkey || '; ', 20) END AS error_message,
               'r' || o_custkey AS lambda_request_id,
               CAST(CASE WHEN o_orderstatus = 'P' THEN o_custkey % 3 ELSE 0 END AS INTEGER) AS retry_count
        FROM orders""",
    "v_cells": f"""
        SELECT 'orders.csv' AS file, u.ordinal, u.name, u.value FROM orders, LATERAL (VALUES
            (0, 'Order Key', CAST(o_orderkey AS VARCHAR)),
            (1, 'Customer-Key', CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE CAST(o_custkey AS VARCHAR) END),
            (2, 'Order Date', {_sql_pick("o_orderkey", "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%-d-%-m-%Y')", "strftime(o_orderdate, '%-m/%-d/%Y')")}),
            (3, 'Loaded At', CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END),
            (4, '1st Priority', o_orderpriority),
            (5, 'Total', ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' '),
            (6, 'open?', {_sql_pick("o_orderkey", "'yes'", "'N'", "'true'")}),
            (7, 'Paid', CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE {_sql_pick("o_orderkey", "'yes'", "'no'")} END),
            (8, 'Flag', CAST(o_orderkey % 2 AS VARCHAR)),
            (9, '__', '')) u(ordinal, name, value)
        UNION ALL
        SELECT 'part.csv', u.ordinal, u.name, u.value FROM part, LATERAL (VALUES
            (0, 'Part Key', CAST(p_partkey AS VARCHAR)), (1, 'Brand', p_brand), (2, 'P Type', p_type),
            (3, 'p.size', CASE WHEN p_partkey % 7 = 0 THEN '1_000' ELSE CAST(p_size AS VARCHAR) END),
            (4, 'Ratio', CASE WHEN p_partkey % 9 = 0 THEN 'nan' ELSE CAST(p_size AS VARCHAR) || 'e-2' END),
            (5, 'Bad Date', CASE WHEN p_partkey % 3 = 0 THEN '2024-02-30' ELSE '2024-02-29' END)) u(ordinal, name, value)
        UNION ALL
        SELECT 'customer.csv', u.ordinal, u.name, u.value FROM customer, LATERAL (VALUES
            (0, 'Cust Key', CAST(c_custkey AS VARCHAR)), (1, 'Name', c_name),
            (2, 'Segment', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END)) u(ordinal, name, value)""",
    "v_profile": """
        SELECT file, ordinal, trim(name) AS name,
               coalesce(bool_and(regexp_full_match(v, '[+-]?[0-9]+(_[0-9]+)*')) FILTER (v <> ''), true) AS is_int,
               coalesce(bool_and(try_cast(replace(v, '_', '') AS DOUBLE) IS NOT NULL) FILTER (v <> ''), true) AS is_float,
               coalesce(bool_and(lower(v) IN ('true','false','t','f','yes','no','y','n','0','1')) FILTER (v <> ''), true) AS is_bool,
               coalesce(bool_and(try_strptime(v, ['%Y-%m-%d', '%d-%m-%Y', '%m/%d/%Y']) IS NOT NULL) FILTER (v <> ''), true) AS is_date,
               coalesce(bool_and(try_strptime(v, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d-%m-%Y %H:%M:%S']) IS NOT NULL) FILTER (v <> ''), true) AS is_datetime,
               CAST(coalesce(max(length(v)) FILTER (v <> ''), 0) AS INTEGER) AS max_len,
               coalesce(bool_or(v = ''), false) AS nullable
        FROM (SELECT file, ordinal, name, trim(value) AS v FROM v_cells) GROUP BY file, ordinal, name""",
    "v_types": r"""
        SELECT *, CASE WHEN is_datetime THEN 'DATETIME' WHEN is_date THEN 'DATE'
                       WHEN is_int AND NOT nullable THEN 'BIGINT'
                       WHEN is_float AND NOT nullable THEN 'DECIMAL(38,10)'
                       WHEN is_bool AND NOT is_int THEN 'TINYINT(1)'
                       ELSE 'VARCHAR(' || least(greatest(CASE WHEN max_len = 0 THEN 255 ELSE max_len END, 1), 1024) || ')' END AS column_type,
               CASE WHEN trim(regexp_replace(name, '[^0-9a-zA-Z]+', '_', 'g'), '_') = '' THEN 'col'
                    ELSE lower(regexp_replace(trim(regexp_replace(name, '[^0-9a-zA-Z]+', '_', 'g'), '_'), '^([0-9])', 'c_\1')) END AS snake
        FROM v_profile""",
}

# Views each view reads.
_NEEDS = {
    "v_cellsum": ("v_lines",),
    "v_balances": ("v_cellsum",),
    "v_questions": ("v_members",),
    "v_requests": ("v_members",),
    "v_profile": ("v_cells",),
    "v_types": ("v_profile",),
    "v_remote": ("v_listing",),
}


def with_views(body: str, *views: str) -> str:
    """``body`` preceded by the named views and those they read."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for need in _NEEDS.get(name, ()):
            add(need)

    for v in views:
        add(v)
    listed = [f"{n} AS ({sql.strip()})" for n, sql in VIEWS.items() if n in wanted]
    head = "WITH " + ",\n".join(listed) + "\n" if listed else ""
    return head + body.strip()
