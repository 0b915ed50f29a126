"""Question to answer: intent, verification, benefits, balances, one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names, question_text
from ledgerline.operators import benefits, deductibles, members as member_ops
from ledgerline.operators.spread import lookup_join
from ledgerline.session import checkpointed
from ledgerline.operators.questions import EMPTY_QUESTION, question_intents

# The texts of an answer and the year of its balances.
BALANCE_YEAR = 2025
NO_IDENTIFIER = "member_id or dob required (plan_name/group_number not available in current schema)"
NOT_VERIFIED = "Member verification failed"
PROCESSED = "Query processed"
NO_QUESTION = "Please provide a query to process."
BALANCE_LINES = (
    ("Deductible IND", "deductible", "individual"),
    ("Deductible FAM", "deductible", "family"),
    ("OOP IND", "out_of_pocket", "individual"),
    ("OOP FAM", "out_of_pocket", "family"),
)


def _whole_dollars(amount: Column) -> Column:
    """No decimals, halves to even; a small negative amount keeps its sign."""
    rounded = F.bround(amount, 0).cast("bigint")
    return F.when((amount < 0) & (rounded == 0), F.lit("-0")).otherwise(rounded.cast("string"))


def balance_lines(rows: DataFrame, plan_year: int = BALANCE_YEAR) -> DataFrame:
    """One row per member: ``balance_text``, four in-network remainders."""
    flat = deductibles.flat_balances(rows.where(F.col("plan_year") == plan_year))
    lines = [
        F.concat(
            F.lit(f"  {label} (In-Network): $"),
            _whole_dollars(F.col(f"{deductibles.cell_name(kind, level, 'in_network')}_remaining")),
            F.lit(" remaining"),
        )
        for label, kind, level in BALANCE_LINES
    ]
    return flat.select("member_id", F.concat_ws("\n", *lines).alias("balance_text"))


def answer_questions(
    questions: DataFrame, members: DataFrame, accumulator: DataFrame, deductible_rows: DataFrame
) -> DataFrame:
    """The answer to each question (question_id, question): ``status``,
    ``summary`` or ``error``, and the ``reply`` shown to the caller.

    Questions meet their members first. Benefits and balances are then folded
    for the members found whose question asks for a summary, and for no others.
    """
    asked = question_intents(questions).select(
        F.col("question_id").alias("request_id"),
        "question",
        "member_id",
        "dob",
        F.coalesce("member_id", "dob", "plan_name", "group_number").isNotNull().alias("has_identifier"),
    )
    keyed = member_ops.members_by_key(members)
    matched = checkpointed(member_ops.match_members(asked, keyed, keep=("question", "has_identifier")))
    shows = question_text.asks_for_summary(F.col("question"))
    wanted = matched.where(F.col("valid") & shows).select("member_id").distinct()
    benefit = benefits.benefit_lines(accumulator.join(wanted, "member_id", "left_semi"))
    balance = balance_lines(deductible_rows.join(wanted, "member_id", "left_semi"))
    # One member may be asked about in a third of the questions.
    known = lookup_join(matched, benefit, ["member_id"], ["request_id"])
    known = lookup_join(known, balance, ["member_id"], ["request_id"], keys=matched)

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("None"))

    full = F.concat_ws(
        "\n",
        F.concat(F.lit("🧾 Member ID: "), shown("member_id"), F.lit(" (DOB: "), shown("dob"), F.lit(")\n")),
        F.concat(F.lit("Name: "), shown("name"), F.lit("\n")),
        F.concat(F.lit("🏥 Benefits\n"), F.nullif("benefit_text", F.lit(""))),
        F.concat(F.lit("\n💰 Deductibles / OOP Summary\n"), "balance_text"),
        F.lit("\n🧩 Plan Info"),
        F.lit("  Member verified in system"),
    )
    blank = F.coalesce(names.strip("question"), F.lit("")) == ""
    error = (
        F.when(blank, F.lit(EMPTY_QUESTION))
        .when(~F.col("has_identifier"), F.lit(NO_IDENTIFIER))
        .when(~F.col("valid"), F.lit(NOT_VERIFIED))
    )
    summary = F.when(shows, full).otherwise(F.lit(PROCESSED))
    reply = (
        F.when(F.coalesce("question", F.lit("")) == "", F.lit(NO_QUESTION))
        .when(F.col("error").isNotNull(), F.concat(F.lit("I encountered an issue: "), "error"))
        .otherwise(F.col("summary"))
    )
    return (
        known.withColumn("error", error)
        .withColumn("summary", F.when(F.col("error").isNull(), summary))
        .select(
            F.col("request_id").alias("question_id"),
            F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
            "summary",
            "error",
            reply.alias("reply"),
        )
    )
