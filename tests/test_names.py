"""Names, paths and keys, against Python's own path rules."""

import pathlib
import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import names


def column(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_snake_names(spark):
    cases = {
        "First Name": "first_name",
        "ZIP-Code": "zip_code",
        "123Data": "c_123data",
        "__": "col",
        "": "col",
        "MemberID": "memberid",
        "  a..b  ": "a_b",
        "Ünï": "n",
    }
    assert [r[0] for r in column(spark, cases, names.snake_case("t"))] == list(cases.values())
    assert [names.snake_name(c) for c in cases] == list(cases.values())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(string.printable + "é　", max_size=12), min_size=1, max_size=40))
def test_snake_column_agrees_with_driver_form(spark, texts):
    got = column(spark, texts, names.snake_case("t"), names.strip("t"))
    assert got == [(names.snake_name(t), t.strip()) for t in texts]


def test_suffix_category_and_table(spark):
    paths = ["/d/A.PDF", "/d/.env", "/d/a.", "/d/a.tar.gz", "/d/plain", "/d/..x", "/d.x/y", "/d/b.JPEG", "/d/My File-1.v2.csv"]
    got = column(spark, paths, names.suffix("t"), names.file_category("t"), names.table_name("t"))
    suffix = lambda p: (m.group(1) if (m := re.match(r"^.+(\.[^.]+)$", pathlib.PurePath(p).name)) else "").lower()
    assert [g[0] for g in got] == [suffix(p) for p in paths]
    assert [g[1] for g in got] == ["pdf", "other", "other", "other", "other", "other", "other", "image", "csv"]
    assert got[8][2] == "my_file_1_v2" and got[1][2] == "col" and got[3][2] == "a_tar"


def test_scopes_and_keys(spark):
    root = "/in/policy/data"
    cases = {
        f"{root}/mba/csv/x.csv": "mba",
        f"{root}/POLICY/a/b.docx": "policy",
        f"{root}/misc/mba/y.txt": "mba",
        f"{root}/misc/mba/policy/y.txt": "policy",
        f"{root}/misc/z.txt": "policy",
        "/else/where.txt": None,
        "/else/mba.txt": None,
    }
    got = column(spark, cases, names.scope_of("t", root))
    assert [g[0] for g in got] == list(cases.values())
    keys = column(
        spark,
        ["/d/x.csv"],
        names.target_key(F.lit("mba"), "t"),
        names.target_key(F.lit("mba"), "t", F.lit("other")),
        names.target_key(F.lit("mba"), "t", F.lit("p/"), with_category=False),
        names.scope_bucket(F.lit(" Policy ")),
        names.scope_prefix(F.lit("none")),
    )
    assert keys == [("mba/csv/x.csv", "other/csv/x.csv", "p/x.csv", "policy-bucket", None)]


def test_extension_lists(spark):
    text = " pdf, CSV,,.txt,csv"
    assert sorted(column(spark, [text], names.extension_list("t"))[0][0]) == [".csv", ".pdf", ".txt"]
    assert names.parse_extensions(text) == {".csv", ".pdf", ".txt"}
    assert names.parse_extensions("") == set()


def test_header_clash():
    import pytest

    with pytest.raises(ValueError, match="a_b"):
        names.snake_headers(["a b", "A-B"])
