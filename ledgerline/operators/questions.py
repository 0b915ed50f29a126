"""Questions to intents and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names, question_text as text

# Fixed value: the error of a blank question.
EMPTY_QUESTION = "Query cannot be empty"

PARAMETERS = ("member_id", "name", "dob", "service", "plan_year", "plan_name", "group_number")


def question_intents(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add the intent and the parameters of each question as columns. Every
    search takes its first match; the name is never found."""
    q = names.strip(question)
    return questions.select(
        *questions.columns,
        text.intent(q).alias("intent"),
        text.member_id(q).alias("member_id"),
        F.lit(None).cast("string").alias("name"),
        text.birth_date(q).alias("dob"),
        text.service(q).alias("service"),
        text.plan_year(q).alias("plan_year"),
        text.plan_name(q).alias("plan_name"),
        text.group_number(q).alias("group_number"),
    )


def question_batch(questions: DataFrame) -> DataFrame:
    """One result per question of a batch: intent, a ``params`` record, and
    for a blank question the default intent with an error."""
    blank = F.coalesce(names.strip("question"), F.lit("")) == ""
    found = question_intents(questions)
    params = F.struct(*[F.when(~blank, F.col(p)).alias(p) for p in PARAMETERS])
    return found.select(
        *questions.columns,
        F.when(blank, F.lit(text.DEFAULT_INTENT)).otherwise(F.col("intent")).alias("intent"),
        params.alias("params"),
        blank.alias("error"),
        F.when(blank, F.lit(EMPTY_QUESTION)).alias("error_text"),
    )
