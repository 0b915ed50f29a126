"""Tests of text values against the types a CSV column can get."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a boolean column, any case.
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no", "y", "n", "0", "1")

# Widest text column.
MAX_WIDTH = 1024

_DIGITS = r"\d+(?:_\d+)*"
_INT = rf"(?U)^[+-]?{_DIGITS}$"
_FLOAT = (
    rf"(?iU)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)

# A calendar date, its parts in any order: days by length of month, and the
# 29th of February only in leap years. Year 0 is no year.
_YEAR = r"(?:[1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9])"
_LEAP = (
    r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])"
    r"|(?:0[48]|[2468][048]|[13579][26])00)"
)
_TO_28 = r"(?:0?[1-9]|1\d|2[0-8]| [1-9])"
_TO_30 = r"(?:0?[1-9]|[12]\d|30| [1-9])"
_TO_31 = r"(?:0?[1-9]|[12]\d|3[01]| [1-9])"
_MONTHS = (
    (r"(?:0?[13578]|1[02])", _TO_31, _YEAR),
    (r"(?:0?[469]|11)", _TO_30, _YEAR),
    (r"0?2", _TO_28, _YEAR),
    (r"0?2", "29", _LEAP),
)
_CLOCK = r"(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d"


def _calendar(layout: str) -> str:
    choices = [layout.format(m=m, d=d, y=y) for m, d, y in _MONTHS]
    return "(?:" + "|".join(choices) + ")"


_ISO_DAY = _calendar("{y}-{m}-{d}")
_DAY_FIRST = _calendar("{d}-{m}-{y}")
_MONTH_FIRST = _calendar("{m}/{d}/{y}")
_DATE = f"^(?:{_ISO_DAY}|{_DAY_FIRST}|{_MONTH_FIRST})$"
_DATETIME = rf"^(?:{_ISO_DAY}(?:\s+|[Tt]){_CLOCK}|{_DAY_FIRST}\s+{_CLOCK})$"


def is_integer(v: Column) -> Column:
    return v.rlike(_INT)


def is_float(v: Column) -> Column:
    return v.rlike(_FLOAT)


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin(*BOOLEAN_WORDS)


def is_date(v: Column) -> Column:
    # Most values are ruled out by their length, without the pattern.
    return F.length(v).between(8, 10) & v.rlike(_DATE)


def is_datetime(v: Column) -> Column:
    return (F.length(v) >= 14) & v.contains(":") & v.rlike(_DATETIME)


def column_type() -> Column:
    """The type of a profiled column, from its flags, width and nullability."""
    c = F.col
    width = F.least(F.greatest(F.when(c("max_len") == 0, F.lit(255)).otherwise(c("max_len")), F.lit(1)), F.lit(MAX_WIDTH))
    return (
        F.when(c("is_datetime"), F.lit("DATETIME"))
        .when(c("is_date"), F.lit("DATE"))
        .when(c("is_int") & ~c("nullable"), F.lit("BIGINT"))
        .when(c("is_float") & ~c("nullable"), F.lit("DECIMAL(38,10)"))
        .when(c("is_bool") & ~c("is_int"), F.lit("TINYINT(1)"))
        .otherwise(F.format_string("VARCHAR(%d)", width))
    )


def spark_type(column_type: Column) -> Column:
    """The Spark name of a type given by `column_type`. Text has no width:
    what a profile saw says nothing about later files."""
    return (
        F.when(column_type == "DATETIME", F.lit("TIMESTAMP_NTZ"))
        .when(column_type == "TINYINT(1)", F.lit("BOOLEAN"))
        .when(column_type.startswith("VARCHAR"), F.lit("STRING"))
        .otherwise(column_type)
    )


def typed(v: Column, type_name: str) -> Column:
    """A trimmed text value as ``type_name``; NULL when it does not fit."""
    kind = type_name.lower()
    if kind == "date":
        day = F.replace(v, F.lit(" "), F.lit(""))
        return F.when(
            v.rlike(_DATE),
            F.coalesce(
                F.try_to_date(day, "yyyy-M-d"),
                F.try_to_date(day, "d-M-yyyy"),
                F.try_to_date(day, "M/d/yyyy"),
            ),
        )
    if kind == "timestamp_ntz":
        day = F.regexp_replace(F.regexp_extract(v, r"^(.*\d)(?:\s+|[Tt])\d+:", 1), " ", "")
        clock = F.regexp_extract(v, r"(\d+:\d+:\d+)$", 1)
        moment = F.concat(day, F.lit(" "), clock)
        parsed = F.coalesce(
            F.try_to_timestamp(moment, F.lit("yyyy-M-d H:m:s")),
            F.try_to_timestamp(moment, F.lit("d-M-yyyy H:m:s")),
        )
        return F.when(v.rlike(_DATETIME), parsed.cast("timestamp_ntz"))
    if kind == "bigint" or kind.startswith("decimal"):
        return F.replace(v, F.lit("_"), F.lit("")).try_cast(type_name)
    if kind == "boolean":
        return F.when(is_boolean(v), v.try_cast("boolean"))
    if kind.startswith(("varchar", "char")):
        width = int(kind[kind.index("(") + 1 : -1])
        return F.when(F.length(v) <= width, v)
    return v.try_cast(type_name)
