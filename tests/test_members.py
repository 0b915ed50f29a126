"""Benefits, balances, verification, questions and the member summary."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import question_text
from ledgerline.operators import benefits, deductibles, members, questions
from ledgerline.plans.summary import answer_questions
from ledgerline.sources import tables


@pytest.fixture(scope="module")
def people(spark):
    # The sample members.
    rows = [
        ("M1001", "Brandi", "Kim", "2005-05-23"),
        ("M1002", "Anthony", "Brown", "1987-12-14"),
        ("M1003", "Kimberly", "Ramirez", "2001-08-30"),
        ("M1004", "Jennifer", "Bolton", "1977-12-10"),
        ("M1005", "Gabrielle", "Coleman", "1987-01-20"),
    ]
    schema = "member_id string, first_name string, last_name string, dob date"
    return spark.createDataFrame([(*r[:3], dt.date.fromisoformat(r[3])) for r in rows], schema)


@pytest.fixture(scope="module")
def usage(spark):
    rows = [
        ("M1001", "Massage Therapy", "6 visit calendar year maximum", 3, 3),
        ("M1001", "Neurodevelopmental Therapy", "30 visit calendar year maximum", 2, 28),
        ("M1002", "Massage Therapy", "6 visit calendar year maximum", 0, 6),
        ("M1002", "Smoking Cessation", "8 visit calendar year maximum", 5, 3),
        ("M1003", "Neurodevelopmental Therapy", "30 visit calendar year maximum", 20, 10),
        ("M1005", "Massage Therapy", "6 visit calendar year maximum", 6, 0),
    ]
    return spark.createDataFrame(rows, "member_id string, service string, allowed_limit string, used int, remaining int")


@pytest.fixture(scope="module")
def balances(spark):
    caller = spark.createDataFrame([("M1001",), ("M1002",)], "member_id string")
    return deductibles.routine_balances(caller).withColumn("plan_year", F.lit(2025))


def by(df, key="request_id"):
    return {r[key]: r for r in df.collect()}


def test_benefit_lookup(spark, usage):
    asked = [
        (1, "M1001", "Massage Therapy"),
        (2, " M1002 ", "Smoking Cessation"),
        (3, "M1005", "Massage Therapy"),
        (4, "M9999", "Massage Therapy"),
        (5, "M1001", "Invalid Service"),
        (6, "", "Massage Therapy"),
        (7, "M1001", "  "),
    ]
    got = by(benefits.benefit_lookup(spark.createDataFrame(asked, "request_id int, member_id string, service string"), usage))
    assert [got[i].status for i in range(1, 8)] == ["success"] * 3 + ["not_found"] * 2 + ["error"] * 2
    assert (got[2].used, got[2].remaining) == (5, 3)
    assert got[4].message == "No benefit accumulator data found for M9999 - Massage Therapy"
    assert (got[6].message, got[7].message) == ("member_id cannot be empty", "service cannot be empty")
    with pytest.raises(ValueError):
        benefits.benefit_rows(usage, "M1001", " ")
    assert benefits.benefit_rows(usage, "M1001", "massage therapy").isEmpty()
    assert benefits.benefit_rows(usage, "m1001", "massage therapy", any_case=True).count() == 1


def test_all_benefits(usage):
    got = benefits.all_benefits(usage).where("member_id = 'M1001'").orderBy("ordinal").collect()
    assert [(r.ordinal, r.service) for r in got] == [(1, "Massage Therapy"), (3, "Neurodevelopmental Therapy")]


def test_structured_balances(balances):
    got = deductibles.structured_balances(balances).collect()
    assert len(got) == 1
    r = got[0].asDict(recursive=True)
    money = lambda *v: dict(zip(("limit", "used", "remaining"), map(Decimal, v)))
    assert r["individual_deductible"]["in_network"] == money("1500.00", "350.00", "1150.00")
    assert r["family_deductible"]["out_of_network"] == money("6000.00", "0.00", "6000.00")
    assert r["out_of_pocket_maximum"]["family"]["in_network"] == money("10000.00", "2400.00", "7600.00")


def test_balance_edges(spark):
    cell = ("Deductible", "INDIVIDUAL", "In-Network")
    rows = [
        ("A", 2025, *cell, "100", "10", "5", 1),
        ("A", 2025, *cell, "90", "10", "5", 2),
        ("A", 2025, *cell, None, "10", "5", 3),
        ("A", 2025, *cell, "oops", "10", "5", 4),
        ("A", 2025, "copay", "individual", "in_network", "1", "1", "1", 5),
        ("A", 2025, "deductible", "group", "in_network", "1", "1", "1", 6),
        ("B", 2025, "copay", "individual", "in_network", "1", "1", "1", 7),
    ]
    names = ["member_id", "plan_year", "deductible_type", "coverage_level", "network_type"]
    schema = ", ".join(f"{n} {'int' if n == 'plan_year' else 'string'}" for n in names)
    df = spark.createDataFrame(rows, schema + ", limit_amount string, used_amount string, remaining_amount string, seq int")
    got = by(deductibles.flat_balances(df, "seq"), "member_id")
    a = got["A"]
    assert (a.ded_individual_in_network_limit, a.ded_individual_in_network_remaining) == (90, 80)
    assert sum(v for k, v in a.asDict().items() if k.startswith("oop")) == 0
    # A member with ignored rows only has all cells zero.
    assert sum(v for k, v in got["B"].asDict().items() if k[:3] in ("ded", "oop")) == 0


def test_balance_requests(spark, balances):
    flat = deductibles.flat_balances(balances)
    asked = spark.createDataFrame(
        [
            (1, "M1001", 2025, "in_network", "individual"),
            (2, "M1001", 1999, "in_network", "family"),
            (3, "M1003", 2025, "out_of_network", "family"),
            (4, "M1001", 2025, "In-Network", "family"),
            (5, " ", 2025, "in_network", "family"),
            (6, "M1001", 2025, "out_of_network", "group"),
        ],
        "request_id int, member_id string, plan_year int, network_type string, coverage_level string",
    )
    full = by(deductibles.balance_lookup(asked, flat))
    assert [full[i].status for i in range(1, 7)] == ["success", "error", "not_found", "success", "error", "success"]
    assert full[3].message == "No deductible/OOP data found for member M1003 in plan year 2025"
    assert full[2].message == "plan_year must be a valid integer between 2020 and 2030"
    own = by(deductibles.individual_deductible(asked, flat))
    assert (own[1].limit, own[1].used, own[1].remaining) == (1500, 350, 1150)
    assert own[4].message == "network_type must be 'in_network' or 'out_of_network'"
    assert by(deductibles.family_deductible(asked, flat))[1].remaining == 2250
    top = by(deductibles.out_of_pocket_maximum(asked, flat))
    assert top[1].remaining == 3800
    assert top[6].message == "coverage_level must be 'individual' or 'family'"
    assert deductibles.balances_of(balances, "M1001", 2025).count() == 8
    for bad in (1999, "2025", True):
        with pytest.raises(ValueError):
            deductibles.balances_of(balances, "M1001", bad)
    with pytest.raises(ValueError):
        deductibles.cell_lookup(asked, flat, "deductible", "group")


def test_verification(spark, people):
    asked = [
        (1, "M1001", "2005-05-23"),
        (2, "M1001", "1990-01-01"),
        (3, "M1002", None),
        (4, None, "1987-12-14"),
        (5, None, ""),
        (6, "m1001", None),
    ]
    df = spark.createDataFrame(asked, "request_id int, member_id string, dob string")
    got = by(members.verify_members(df, people))
    assert [got[i].valid for i in range(1, 7)] == [True, False, True, True, False, False]
    assert (got[4].member_id, got[4].name, got[4].dob) == ("M1002", "Anthony Brown", "1987-12-14")
    assert got[5].message == "At least one identifier required" and got[2].message == "Authentication failed"
    assert by(members.verify_members(df, people, any_case=True))[6].member_id == "M1001"
    renamed = people.withColumnRenamed("dob", "date_of_birth")
    assert by(members.verify_members(df, renamed))[1].valid
    one = members.verify_member(people, dob="1987-12-14").first()
    assert (one.member_id, one.name) == ("M1002", "Anthony Brown")
    for given in ({}, {"member_id": "M1001", "need_both": True}):
        with pytest.raises(ValueError):
            members.verify_member(people, **given)


def test_verification_of_hot_keys(spark):
    """Members and requests that share a date or an id in a third of the rows."""
    rng = random.Random(5)
    day = lambda i: dt.date(1900, 1, 1) if i % 3 == 0 else dt.date(1950, 1, 1) + dt.timedelta(days=i % 50)
    known = [(f"M{i % 400}", f"F{i}", f"L{i % 7}", day(i)) for i in range(600)]
    known += [(None, "No", "Id", day(1)), ("M1", None, "X", None)]
    people = spark.createDataFrame(known, "member_id string, first_name string, last_name string, dob date")
    asked = []
    for i in range(500):
        member = "M0" if i % 3 == 0 else rng.choice([f"M{rng.randint(0, 500)}", None, ""])
        asked.append((i, member, rng.choice([str(day(rng.randint(0, 99))), None, ""])))
    df = spark.createDataFrame(asked, "request_id int, member_id string, dob string")
    got = by(members.verify_members(df, people))
    assert len(got) == 500
    for i, member, dob in asked:
        hits = [
            (m, str(d))
            for m, _, _, d in known
            if (member or dob) and (not member or m == member) and (not dob or str(d) == dob)
        ]
        assert got[i].valid == bool(hits), (member, dob)
        if hits and all(m for m, _ in hits):
            assert got[i].member_id == min(m for m, _ in hits)


def test_two_stages(spark, people):
    asked = [
        (1, "M1001", "2005-05-23", None),
        (2, "M0", "1987-12-14", "Brown"),
        (3, "M0", "1987-12-14", "Nobody"),
        (4, "M0", "1987-12-14", "A_thony B%n"),
        (5, "M0", "1987-12-14", "ow"),
        (6, "M0", "1987-12-14", "%"),
        (7, "M0", "1987-12-14", r"A\nthony"),
        (8, None, None, "Brown"),
        (9, "M1002", "1987-12-14", "Nobody"),
    ]
    df = spark.createDataFrame(asked, "request_id int, member_id string, dob string, member_name string")
    plain = by(members.verify_in_two_stages(df, people))
    assert {i: r.status for i, r in plain.items()} == {1: "verified", 3: "invalid", 8: "invalid", 9: "verified"}
    assert plain[1].name == "Brandi Kim" and plain[3].member_id is None
    shown = by(members.verify_in_two_stages(df, people, show_name_only=True))
    assert {i for i, r in shown.items() if r.status == "verified_by_name"} == {2, 4, 5, 6, 7}


def test_name_matches_against_plain_python(spark):
    rng = random.Random(9)
    known = [("A" + "".join(rng.choice("ab_%c") for _ in range(rng.randint(0, 6))), dt.date(1900, 1, rng.choice([1, 1, 2]))) for _ in range(80)]
    people = spark.createDataFrame([("M", n, "z", d) for n, d in known], "member_id string, first_name string, last_name string, dob date")
    asked = {("".join(rng.choice("ab_%c zA") for _ in range(rng.randint(0, 5))), f"1900-01-0{rng.randint(1, 3)}") for _ in range(300)}
    df = spark.createDataFrame(sorted(asked), "member_name string, dob string")

    def like(name, pattern):
        parts = [{"%": ".*", "_": "."}.get(c, re.escape(c)) for c in f"%{pattern}%"]
        return re.fullmatch("".join(parts), name, re.S)

    want = {(d, p) for p, d in asked if any(str(b) == d and like(f"{n} z", p) for n, b in known)}
    got = [(r.dob, r.member_name) for r in members.name_matches(df, people).collect()]
    assert len(got) == len(set(got)) and set(got) == want


QUESTIONS = [
    ("What's my deductible for member M1001?", "get_deductible_oop", "M1001", None, None, None, None, 2025),
    ("Check remaining Massage Therapy benefits for John Doe", "get_benefit_accumulator", None, None, "Massage Therapy", None, None, 2025),
    ("Verify my identity, DOB 1990-05-15", "verify_member", None, "1990-05-15", None, None, None, 2025),
    ("Show out-of-pocket maximum for 2025", "get_deductible_oop", None, None, None, None, None, 2025),
    ("How much Physical Therapy benefit remaining?", "get_benefit_accumulator", None, None, "Physical Therapy", None, None, 2025),
    ("Show all deductible and out-of-pocket information for member_id=M1002 dob=1987-12-14", "get_deductible_oop", "M1002", "1987-12-14", None, None, None, 2025),
    ("Give me complete details for member_id=M1002 dob=1987-12-14", "verify_member", "M1002", "1987-12-14", None, None, None, 2025),
    ("What are my benefits for member_id=M1001", "get_benefit_accumulator", "M1001", None, None, None, None, 2025),
    ("Show deductible for plan_name=020213CA", "get_deductible_oop", None, None, None, "020213CA", None, 2025),
    ("Get benefits for group_number=20213", "get_benefit_accumulator", None, None, None, None, "20213", 2025),
    ("How much Massage Therapy benefit remaining? member_id=M1001 dob=2005-05-23", "get_benefit_accumulator", "M1001", "2005-05-23", "Massage Therapy", None, None, 2005),
    ("Validate member M1003 born 2001-08-30", "verify_member", "M1003", "2001-08-30", None, None, None, 2001),
    ("Check Smoking Cessation benefits for M1002 dob=1987-12-14", "get_benefit_accumulator", "M1002", "1987-12-14", None, None, None, 2025),
    ("What's my deductible for 2025? member_id=M1001 dob=2005-05-23", "get_deductible_oop", "M1001", "2005-05-23", None, None, None, 2025),
    ("Verify member identity", "verify_member", "entity", None, None, None, None, 2025),
    ("my loop is open", "get_deductible_oop", None, None, None, None, None, 2025),
    ("Show all benefits for member_id=M1001", "get_benefit_accumulator", "M1001", None, None, None, None, 2025),
]


def test_questions(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "question_id int, question string")
    got = by(questions.question_intents(df), "question_id")
    for i, (_, intent, member, dob, service, plan, group, year) in enumerate(QUESTIONS):
        r = got[i]
        assert (r.intent, r.member_id, r.dob, r.service, r.plan_name, r.group_number, r.plan_year, r.name) == (
            intent, member, dob, service, plan, group, year, None,
        ), QUESTIONS[i][0]


def test_question_batch(spark):
    df = spark.createDataFrame([(1, "  "), (2, None), (3, "Check usage 2023")], "question_id int, question string")
    got = by(questions.question_batch(df), "question_id")
    for i in (1, 2):
        assert (got[i].intent, got[i].error, got[i].error_text) == ("verify_member", True, "Query cannot be empty")
    assert (got[3].intent, got[3].params.plan_year, got[3].error) == ("get_benefit_accumulator", 2023, False)


SUMMARY = """🧾 Member ID: M1001 (DOB: 2005-05-23)

Name: Brandi Kim

🏥 Benefits
  Massage Therapy: 3 used, 3 remaining (Limit: 6 visit calendar year maximum)
  Neurodevelopmental Therapy: 2 used, 28 remaining (Limit: 30 visit calendar year maximum)

💰 Deductibles / OOP Summary
  Deductible IND (In-Network): $1150 remaining
  Deductible FAM (In-Network): $2250 remaining
  OOP IND (In-Network): $3800 remaining
  OOP FAM (In-Network): $7600 remaining

🧩 Plan Info
  Member verified in system"""


def test_summary(spark, people, usage, balances):
    asked = {
        1: "Show me all my information member_id=M1001 dob=2005-05-23",
        2: "What are my benefits for member_id=M1001",
        3: "Give me complete details for member_id=M1002 dob=1987-12-14",
        4: "Show deductible for plan_name=020213CA",
        5: "my loop is open",
        6: "",
        7: "   ",
        8: "Show all benefits for member_id=M1001",
        9: "Show everything for dob=1977-12-10",
        10: "Verify member identity",
    }
    df = spark.createDataFrame(list(asked.items()), "question_id int, question string")
    got = by(answer_questions(df, people, usage, balances), "question_id")
    assert got[1].summary == got[8].summary == got[1].reply == SUMMARY
    assert got[2].summary == "Query processed"
    assert "Deductibles" not in got[3].summary and "Smoking Cessation: 5 used" in got[3].summary
    assert got[4].reply == "I encountered an issue: Member verification failed"
    assert got[5].error.startswith("member_id or dob required")
    assert got[6].reply == "Please provide a query to process."
    assert got[7].reply == "I encountered an issue: Query cannot be empty"
    assert got[9].summary == (
        "🧾 Member ID: M1004 (DOB: 1977-12-10)\n\nName: Jennifer Bolton\n\n\n🧩 Plan Info\n  Member verified in system"
    )
    assert got[10].error == "Member verification failed"


def test_whole_dollars(spark):
    from ledgerline.plans.summary import _whole_dollars

    amounts = ["2.50", "3.50", "0.50", "-0.30", "-0.50", "-1.50", "0.00", "1150.49"]
    df = spark.createDataFrame([(Decimal(a),) for a in amounts], "a decimal(18,2)")
    assert [r[0] for r in df.select(_whole_dollars(F.col("a"))).collect()] == [f"{float(a):.0f}" for a in amounts]


def test_routines(spark, usage):
    known = tables.Routines()
    known.register("GetBenefitAccumulator", lambda m, s, year: benefits.benefit_rows(usage, m, s))
    status, found = known.call_with_status("GetBenefitAccumulator", ["M1001", "Massage Therapy", 2025])
    assert (status, found.count()) == ("success", 1)
    assert known.call_with_status("GetBenefitAccumulator", ["M9", "Massage Therapy", 2025])[0] == "not_found"
    with pytest.raises(KeyError):
        known.call("other")


def test_digits_of_other_scripts_are_years(spark):
    texts = [(1, "deductible for 20٢٣ please"), (2, "year 20२४"), (3, "no year"), (4, "2022")]
    asked = spark.createDataFrame(texts, "question_id long, question string")
    found = {r[0]: r[1] for r in asked.select("question_id", question_text.plan_year(F.col("question"))).collect()}
    assert found == {1: 2023, 2: 2024, 3: 2025, 4: 2022}
    assert questions.question_intents(asked).count() == 4


def test_balances_are_combined_by_hash(spark):
    rows = spark.createDataFrame(
        [("M1", 2024, "deductible", "individual", "in_network", a, b, k) for k, (a, b) in enumerate([("-5.25", "1"), ("7", "0.50"), ("7", "0.75"), (None, "9")])],
        "member_id string, plan_year int, deductible_type string, coverage_level string, network_type string,"
        " limit_amount string, used_amount string, seq long",
    )
    largest, last = deductibles.flat_balances(rows), deductibles.flat_balances(rows.where("seq < 2"), F.col("seq") * -1)
    assert largest.first()["ded_individual_in_network_limit"] == Decimal("7.00")
    assert largest.first()["ded_individual_in_network_used"] == Decimal("0.75")
    assert last.first()["ded_individual_in_network_remaining"] == Decimal("-6.25")
    assert last.first()["oop_family_in_network_limit"] == 0
    for df in (largest, last):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
