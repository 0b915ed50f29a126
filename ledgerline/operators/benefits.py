"""Benefit accumulators: one service, or all services of a member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators.spread import lookup_join

# The services of a full benefit listing, in its order.
SERVICES = (
    "Massage Therapy",
    "Physical Therapy",
    "Neurodevelopmental Therapy",
    "Skilled Nursing Facility",
    "Smoking Cessation",
    "Rehabilitation – Outpatient",
)

_USAGE = ("allowed_limit", "used", "remaining")


def _folded(c: str, any_case: bool) -> Column:
    return F.collate(F.col(c), "UNICODE_CI_AI") if any_case else F.col(c)


def benefit_rows(accumulator: DataFrame, member_id: str, service: str, any_case: bool = False) -> DataFrame:
    """All accumulator rows of one member and service; the plan year plays no
    part. ``any_case`` ignores case and accents."""
    for name, value in (("member_id", member_id), ("service", service)):
        if not value or not value.strip():
            raise ValueError(f"{name} cannot be empty")
    if any_case:
        test = (_folded("member_id", True) == F.lit(member_id.strip())) & (
            _folded("service", True) == F.lit(service.strip())
        )
    else:
        test = (F.col("member_id") == member_id.strip()) & (F.col("service") == service.strip())
    return accumulator.where(test).select("member_id", "service", *_USAGE)


def _one_per_service(accumulator: DataFrame) -> DataFrame:
    """One row per member and service: the smallest by limit, used, remaining."""
    first = F.min(F.struct(*_USAGE)).alias("first")
    return accumulator.groupBy("member_id", "service").agg(first).select("member_id", "service", "first.*")


def benefit_lookup(requests: DataFrame, accumulator: DataFrame, any_case: bool = False) -> DataFrame:
    """The benefit of each request (request_id, member_id, service), with
    status success, not_found or error. ``any_case`` ignores case and accents."""
    asked = requests.select(
        "request_id",
        F.coalesce(names.strip("member_id"), F.lit("")).alias("member_id"),
        F.coalesce(names.strip("service"), F.lit("")).alias("service"),
    ).withColumns({"k_member": _folded("member_id", any_case), "k_service": _folded("service", any_case)})
    folded = accumulator.withColumns({c: _folded(c, any_case) for c in ("member_id", "service")})
    rows = _one_per_service(folded).withColumnsRenamed({"member_id": "k_member", "service": "k_service"})
    blank = (F.col("member_id") == "") | (F.col("service") == "")
    found = F.coalesce("found", F.lit(False))
    # The messages of a lookup.
    missing = F.concat(
        F.lit("No benefit accumulator data found for "), "member_id", F.lit(" - "), "service"
    )
    blank_text = F.when(F.col("member_id") == "", F.lit("member_id cannot be empty")).otherwise(
        F.lit("service cannot be empty")
    )
    return lookup_join(asked, rows.withColumn("found", F.lit(True)), ["k_member", "k_service"], ["request_id"]).select(
        "request_id",
        "member_id",
        "service",
        F.when(blank, F.lit("error")).when(found, F.lit("success")).otherwise(F.lit("not_found")).alias("status"),
        *_USAGE,
        F.when(blank, blank_text).when(~found, missing).alias("message"),
    )


def all_benefits(accumulator: DataFrame) -> DataFrame:
    """The listed services every member has, numbered in listing order."""
    ordinals = F.create_map(*[F.lit(x) for i, s in enumerate(SERVICES, 1) for x in (s, i)])
    return (
        _one_per_service(accumulator.where(F.col("service").isin(*SERVICES)))
        .withColumn("ordinal", F.try_element_at(ordinals, F.col("service")))
        .select("member_id", "ordinal", "service", *_USAGE)
    )


def _text(c: Column) -> Column:
    """A value inside a sentence; a NULL is written out."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def benefit_lines(accumulator: DataFrame) -> DataFrame:
    """One row per member: ``benefit_text``, a line for each listed service.

    The six services are picked in one grouping, so the state per member is
    six small rows however many rows the member has.
    """
    usage = F.struct(*_USAGE)
    picks = [F.min(F.when(F.col("service") == s, usage)).alias(f"s{i}") for i, s in enumerate(SERVICES)]
    picked = accumulator.where(F.col("service").isin(*SERVICES)).groupBy("member_id").agg(*picks)
    lines = [
        F.when(
            F.col(f"s{i}").isNotNull(),
            F.concat(
                F.lit(f"  {s}: "),
                _text(F.col(f"s{i}.used")),
                F.lit(" used, "),
                _text(F.col(f"s{i}.remaining")),
                F.lit(" remaining (Limit: "),
                _text(F.col(f"s{i}.allowed_limit")),
                F.lit(")"),
            ),
        )
        for i, s in enumerate(SERVICES)
    ]
    return picked.select("member_id", F.concat_ws("\n", *lines).alias("benefit_text"))
