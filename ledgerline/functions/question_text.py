"""Intent and parameters of a free-text question, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and defaults of the question rules.
MEMBER_ID = r"member[_\s]*id[=:\s]*([A-Z0-9]+)"
MEMBER_CODE = r"\bM\d{4}\b"
BIRTH_DATE = r"dob[=:\s]*(\d{4}-\d{2}-\d{2})"
ANY_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
PLAN_NAME = r"plan[_\s]*(?:name|id)[=:\s]*([A-Z0-9]+)"
GROUP_NUMBER = r"group[_\s]*(?:number|id)[=:\s]*(\d+)"
PLAN_YEAR = r"\b20\d{2}\b"
DEFAULT_YEAR = 2025
SERVICES = ("massage therapy", "physical therapy", "chiropractic", "acupuncture")
INTENT_WORDS = (
    ("verify_member", ("verify", "validate", "check identity", "confirm")),
    ("get_deductible_oop", ("deductible", "out-of-pocket", "oop", "maximum")),
    ("get_benefit_accumulator", ("benefit", "remaining", "usage", "accumulator", "balance")),
)
DEFAULT_INTENT = "verify_member"
SUMMARY_WORDS = ("complete", "everything", "all", "show me")


# Decimal digits of all scripts, and the plain digit of each.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_PLAIN = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def _found(text: Column, pattern: str, group: int, any_case: bool = False) -> Column:
    """First match, NULL without one. Digits, blanks and word edges are Unicode."""
    flags = "(?iU)" if any_case else "(?U)"
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def member_id(q: Column) -> Column:
    return F.coalesce(_found(q, MEMBER_ID, 1, any_case=True), _found(q, MEMBER_CODE, 0))


def birth_date(q: Column) -> Column:
    return F.coalesce(_found(q, BIRTH_DATE, 1, any_case=True), _found(q, ANY_DATE, 0))


def plan_name(q: Column) -> Column:
    return _found(q, PLAN_NAME, 1, any_case=True)


def group_number(q: Column) -> Column:
    return _found(q, GROUP_NUMBER, 1, any_case=True)


def service(q: Column) -> Column:
    lowered = F.lower(q)
    return F.coalesce(*[F.when(lowered.contains(s), F.lit(s.title())) for s in SERVICES])


def plan_year(q: Column) -> Column:
    year = F.translate(_found(q, PLAN_YEAR, 0), "".join(_DIGITS), _PLAIN)
    return F.coalesce(year.try_cast("int"), F.lit(DEFAULT_YEAR))


def intent(q: Column) -> Column:
    lowered = F.lower(q)
    tests = [F.when(_has_any(lowered, words), F.lit(name)) for name, words in INTENT_WORDS]
    return F.coalesce(*tests, F.lit(DEFAULT_INTENT))


def asks_for_summary(q: Column) -> Column:
    return _has_any(F.lower(q), SUMMARY_WORDS)
