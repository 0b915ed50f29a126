"""Type tests and profiles, against Python's own parsers."""

import datetime as dt
import random
import string

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import value_types
from ledgerline.operators import profile


def parses(fn):
    def test(v):
        try:
            fn(v)
            return True
        except ValueError:
            return False

    return test


def by_format(*formats):
    return lambda v: any(parses(lambda x, f=f: dt.datetime.strptime(x, f))(v) for f in formats)


# The words of a boolean column.
BOOLEAN_WORDS = ["true", "false", "t", "f", "yes", "no", "y", "n", "0", "1"]

EXPECTED = {
    "is_int": parses(int),
    "is_float": parses(float),
    "is_bool": lambda v: v.lower() in BOOLEAN_WORDS,
    "is_date": by_format("%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y"),
    "is_datetime": by_format("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d-%m-%Y %H:%M:%S"),
}


def values():
    rng = random.Random(7)
    fixed = "1 +1 -0 1_000 1__0 _1 1_ 1. .5 . 1e5 1e 1_0.0_1e-1_0 nan -inf Infinity infinit 0x1 ١٢ 1.5.2 yes N TRUE maybe".split()
    fixed += "2024-02-29 2023-02-29 1900-02-29 2000-02-29 29-2-2024 2/29/2024 2/30/2024 0000-01-01 2024-13-01 31-4-2024 2024-1-5".split()
    fixed += ["2024-01-05T10:00:00", "2024-01-05t1:2:3", "2024-1-5  23:59:59", "2024-01-05 24:00:00", "5-1-2024 10:00:60"]
    fixed += ["5-1-2024T10:00:00", "2024-01-05 10:00", "2024-01- 5", " 1-01-2024", "9/ 9/2024"]
    made = []
    for _ in range(1500):
        y, m, d = rng.choice([0, 1, 100, 400, 1900, 1996, 2000, 2023, 2024, 9999]), rng.randint(0, 13), rng.randint(0, 32)
        pad = rng.choice(["02d", "d"])
        day = rng.choice([f"{y:04d}-{m:{pad}}-{d:{pad}}", f"{d:{pad}}-{m:{pad}}-{y:04d}", f"{m:{pad}}/{d:{pad}}/{y:04d}"])
        clock = f"{rng.randint(0, 25):{pad}}:{rng.randint(0, 61):{pad}}:{rng.randint(0, 62):{pad}}"
        made.append(rng.choice([day, f"{day} {clock}", f"{day}T{clock}"]))
        made.append("".join(rng.choice("01_.e+-a") for _ in range(rng.randint(1, 6))))
    return sorted({v.strip() for v in fixed + made} - {""})


def test_each_value(spark):
    texts = values()
    v = F.col("v")
    tests = [test(v).alias(name) for name, test in profile.FLAGS.items()]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", *tests).collect()
    wrong = [(r.v, n, r[n]) for r in got for n, test in EXPECTED.items() if r[n] != test(r.v)]
    assert wrong == []


def test_typed_values(spark):
    df = spark.createDataFrame(
        [(t,) for t in ["2024-1-5", "5-1-2024", "1/5/2024", "2024-02-30", "2024-01-05 01:02:03", "5-1-2024 1:2:3", "1_000", "x"]],
        "v string",
    )
    kinds = {k: value_types.typed(F.col("v"), k).cast("string") for k in ("date", "timestamp_ntz", "bigint", "varchar(3)")}
    got = {r.v: r for r in df.select("v", *[c.alias(k) for k, c in kinds.items()]).collect()}
    assert [got[v]["date"] for v in ("2024-1-5", "5-1-2024", "1/5/2024", "2024-02-30")] == ["2024-01-05"] * 3 + [None]
    assert got["2024-01-05 01:02:03"]["timestamp_ntz"] == got["5-1-2024 1:2:3"]["timestamp_ntz"] == "2024-01-05 01:02:03"
    assert got["1_000"]["bigint"] == "1000" and got["x"]["bigint"] is None
    assert got["x"]["varchar(3)"] == "x" and got["1_000"]["varchar(3)"] is None


CASES = [
    (["1", "2", "3"], "BIGINT", False),
    (["1", "", "3"], "VARCHAR(1)", True),
    (["1.5", "2"], "DECIMAL(38,10)", False),
    (["1.5", " "], "VARCHAR(3)", True),
    (["0", "1"], "BIGINT", False),
    (["0", "1", ""], "VARCHAR(1)", True),
    (["yes", "N", "true"], "TINYINT(1)", False),
    (["yes", ""], "TINYINT(1)", True),
    (["2024-01-05", "5-1-2024", "1/5/2024"], "DATE", False),
    (["2024-01-05", ""], "DATE", True),
    (["2024-01-05 10:00:00", "2024-01-05T11:00:00"], "DATETIME", False),
    (["2024-01-05", "2024-01-05 10:00:00"], "VARCHAR(19)", False),
    (["", " "], "DATETIME", True),
    (["x" * 2000], "VARCHAR(1024)", False),
    (["nan", "1"], "DECIMAL(38,10)", False),
    (["99999999999999999999999"], "BIGINT", False),
    ([None, None], "DATETIME", False),
]


def test_column_types(spark):
    cells = [(f"f{i}", 0, "h", v) for i, (vs, _, _) in enumerate(CASES) for v in vs]
    df = spark.createDataFrame(cells, "file string, ordinal int, name string, value string")
    got = {r.file: (r.column_type, r.nullable) for r in profile.with_types(profile.profile_columns(df)).collect()}
    assert got == {f"f{i}": (t, n) for i, (_, t, n) in enumerate(CASES)}


def test_table_definitions(spark):
    cells = [("t", 0, "Member ID", "1"), ("t", 1, "123 Name", "ann"), ("t", 1, "123 Name", "")]
    df = spark.createDataFrame(cells, "table_name string, ordinal int, name string, value string")
    profiled = profile.profile_columns(df.withColumnRenamed("table_name", "file")).withColumnRenamed("file", "table_name")
    assert profile.table_definitions(profiled).first().ddl == (
        "CREATE TABLE IF NOT EXISTS `t` (\n  `member_id` BIGINT NOT NULL,\n  `c_123_name` VARCHAR(3) NULL\n"
        ") ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"
    )
    spark_ddl = profile.table_definitions(profiled, "spark").first().ddl
    assert "`c_123_name` STRING\n) USING parquet" in spark_ddl and "BIGINT COMMENT 'NOT NULL'" in spark_ddl
    with pytest.raises(ValueError):
        profile.table_definitions(profiled, "other")


def test_random_columns(spark):
    """Whole profiles against a plain Python statement of the rules."""
    rng = random.Random(11)
    pools = [
        lambda: str(rng.randint(-9, 99)),
        lambda: f"{rng.random():.3f}",
        lambda: rng.choice(["yes", "no", "0", "1"]),
        lambda: f"2024-{rng.randint(1, 13)}-{rng.randint(1, 31)}",
        lambda: "",
        lambda: "".join(rng.choice(string.ascii_letters) for _ in range(rng.randint(1, 9))),
    ]
    columns = {}
    for i in range(120):
        chosen = rng.sample(pools, rng.choice([1, 1, 2]))
        columns[f"c{i}"] = [rng.choice(chosen)() for _ in range(rng.randint(1, 8))]
    cells = [("f", i, n, v) for i, (n, vs) in enumerate(columns.items()) for v in vs]
    df = spark.createDataFrame(cells, "file string, ordinal int, name string, value string")
    for r in profile.profile_columns(df).collect():
        texts = [v.strip() for v in columns[r.name] if v.strip()]
        for flag, test in EXPECTED.items():
            assert r[flag] == all(map(test, texts)), (columns[r.name], flag)
        assert r.max_len == max(map(len, texts), default=0)
        assert r.nullable == (len(texts) < len(columns[r.name]))
