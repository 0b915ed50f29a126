"""Deductible and out-of-pocket balances: eight cells per member and year."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators.spread import lookup_join

# The kinds of balance and the valid arguments.
TYPES = ("deductible", "out_of_pocket")
LEVELS = ("individual", "family")
NETWORKS = ("in_network", "out_of_network")
YEARS = (2020, 2030)

MONEY = "decimal(18,2)"
AMOUNTS = ("limit", "used", "remaining")

# The balances of the built-in routine, all of one member.
ROUTINE_MEMBER = "M1001"
ROUTINE_ROWS = (
    ("deductible", "individual", "in_network", "1500.00", "350.00", "1150.00"),
    ("deductible", "individual", "out_of_network", "3000.00", "0.00", "3000.00"),
    ("deductible", "family", "in_network", "3000.00", "750.00", "2250.00"),
    ("deductible", "family", "out_of_network", "6000.00", "0.00", "6000.00"),
    ("out_of_pocket", "individual", "in_network", "5000.00", "1200.00", "3800.00"),
    ("out_of_pocket", "individual", "out_of_network", "10000.00", "0.00", "10000.00"),
    ("out_of_pocket", "family", "in_network", "10000.00", "2400.00", "7600.00"),
    ("out_of_pocket", "family", "out_of_network", "20000.00", "0.00", "20000.00"),
)


def cell_name(kind: str, level: str, network: str) -> str:
    return f"{'ded' if kind == 'deductible' else 'oop'}_{level}_{network}"


CELLS = {cell_name(*c): c for c in product(TYPES, LEVELS, NETWORKS)}


# Digits of an amount in cents, moved up by MOVED so that none is negative.
DIGITS, MOVED = 19, 10**18


def _digits(amount: Column) -> Column:
    cents = (amount * 100).cast("decimal(19,0)") + F.lit(MOVED).cast("decimal(19,0)")
    return F.lpad(cents.cast("decimal(19,0)").cast("string"), DIGITS, "0")


def _amount(digits: Column) -> Column:
    """The amount of `_digits`, zero for none."""
    cents = digits.cast("decimal(19,0)") - F.lit(MOVED).cast("decimal(19,0)")
    return F.coalesce((cents / 100).cast(MONEY), F.lit(0).cast(MONEY))


def flat_balances(rows: DataFrame, order_by: str | Column | None = None) -> DataFrame:
    """One row per member and plan year with limit, used and remaining of all
    eight cells, in columns ``<cell>_<amount>``.

    Remaining is limit less used, whatever the input says. Rows with a missing
    amount are skipped, unknown kinds ignored, absent cells zero. Of two rows
    for one cell the later by ``order_by`` stands; without it, the larger.
    Give ``order_by`` as one number or time: a record as the order makes Spark
    sort all rows before it combines any.
    """
    limit, used = (F.col(c).try_cast(MONEY) for c in ("limit_amount", "used_amount"))
    kind = F.concat_ws(
        "/", F.lower("deductible_type"), F.lower("coverage_level"), names.normal_network("network_type")
    )
    number = F.coalesce(*[F.when(kind == "/".join(parts), F.lit(i)) for i, parts in enumerate(CELLS.values())])
    order = F.lit(None) if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
    coded = rows.select(
        "member_id",
        "plan_year",
        F.when(limit.isNotNull() & used.isNotNull(), number).alias("cell"),
        F.concat(_digits(limit), _digits(used)).cast("decimal(38,0)").alias("both"),
        order.alias("ord"),
    )
    # One number holds both amounts of a cell, so the whole state of a group
    # has a fixed width and rows are combined by hash before the shuffle.
    pick = "max(both)" if order_by is None else "max_by(both, ord)"
    picked = coded.groupBy("member_id", "plan_year").agg(
        *[F.expr(f"{pick} FILTER (WHERE cell = {i})").alias(n) for i, n in enumerate(CELLS)]
    )
    apart = [
        _amount(F.substring(F.lpad(F.col(n).cast("string"), 2 * DIGITS, "0"), 1 + k * DIGITS, DIGITS)).alias(f"{n}_{target}")
        for n in CELLS
        for k, target in enumerate(("limit", "used"))
    ]
    picked = picked.select("member_id", "plan_year", *apart)
    amounts = [
        text
        for n in CELLS
        for text in (f"{n}_limit", f"{n}_used", f"cast({n}_limit - {n}_used AS {MONEY}) AS {n}_remaining")
    ]
    return picked.selectExpr("member_id", "plan_year", *amounts)


def _network_pair(kind: str, level: str) -> Column:
    return F.struct(
        *[
            F.struct(*[F.col(f"{cell_name(kind, level, n)}_{a}").alias(a) for a in AMOUNTS]).alias(n)
            for n in NETWORKS
        ]
    )


def structured_balances(rows: DataFrame, order_by: str | Column | None = None) -> DataFrame:
    """`flat_balances` as nested records: individual_deductible,
    family_deductible and out_of_pocket_maximum."""
    return flat_balances(rows, order_by).select(
        "member_id",
        "plan_year",
        _network_pair("deductible", "individual").alias("individual_deductible"),
        _network_pair("deductible", "family").alias("family_deductible"),
        F.struct(*[_network_pair("out_of_pocket", lv).alias(lv) for lv in LEVELS]).alias("out_of_pocket_maximum"),
    )


# Fixed values in the two functions below: the messages of a lookup.
def _argument_error(checked: dict[str, tuple[str, ...]]) -> Column:
    blank = F.col("member_id") == ""
    low, high = YEARS
    year = F.col("plan_year")
    error = F.when(blank, F.lit("member_id cannot be empty")).when(
        year.isNull() | ~year.between(low, high),
        F.lit(f"plan_year must be a valid integer between {low} and {high}"),
    )
    for column, allowed in checked.items():
        wrong = F.col(column).isNull() | ~F.col(column).isin(*allowed)
        text = " or ".join(f"'{a}'" for a in allowed)
        # These are looked at before the member and the year.
        error = F.when(wrong, F.lit(f"{column} must be {text}")).otherwise(error)
    return error


def _answer(requests: DataFrame, balances: DataFrame, checked: dict[str, tuple[str, ...]]) -> DataFrame:
    """Requests joined to their balances, with status and message."""
    asked = requests.withColumn("member_id", F.coalesce(names.strip("member_id"), F.lit("")))
    known = balances.withColumn("found", F.lit(True))
    joined = lookup_join(asked, known, ["member_id", "plan_year"], ["request_id"])
    error = _argument_error(checked)
    found = F.coalesce("found", F.lit(False))
    missing = F.format_string(
        "No deductible/OOP data found for member %s in plan year %d", "member_id", "plan_year"
    )
    status = (
        F.when(error.isNotNull(), F.lit("error")).when(found, F.lit("success")).otherwise(F.lit("not_found"))
    )
    message = F.when(error.isNotNull(), error).when(~found, missing)
    return joined.withColumn("status", status).withColumn("message", message).drop("found")


def balance_lookup(requests: DataFrame, balances: DataFrame) -> DataFrame:
    """All balances of each request (request_id, member_id, plan_year)."""
    answered = _answer(requests, balances, {})
    return answered.select("request_id", "member_id", "plan_year", "status", "message", *_cells(balances))


def _cells(balances: DataFrame) -> list[Column]:
    """Balance columns, shown only where the request succeeded."""
    shown = [c for c in balances.columns if c not in ("member_id", "plan_year")]
    return [F.expr(f"CASE WHEN status = 'success' THEN {c} END AS {c}") for c in shown]


def cell_lookup(
    requests: DataFrame, balances: DataFrame, kind: str, level: str | None = None
) -> DataFrame:
    """One cell per request (request_id, member_id, plan_year, network_type,
    and coverage_level unless ``level`` fixes it)."""
    if kind not in TYPES:
        raise ValueError(f"type must be one of {TYPES}")
    if level is not None and level not in LEVELS:
        raise ValueError("coverage_level must be 'individual' or 'family'")
    checked = {"network_type": NETWORKS}
    asked = requests
    if level is None:
        checked["coverage_level"] = LEVELS
    else:
        asked = requests.withColumn("coverage_level", F.lit(level))
    answered = _answer(asked, balances, checked)

    def amount(a: str) -> Column:
        cases = [
            f"WHEN coverage_level = '{lv}' AND network_type = '{n}' THEN {cell_name(kind, lv, n)}_{a}"
            for lv, n in product(LEVELS, NETWORKS)
        ]
        return F.expr(f"CASE WHEN status <> 'success' THEN NULL {' '.join(cases)} END AS {a}")

    return answered.select(
        "request_id",
        "member_id",
        "plan_year",
        "coverage_level",
        "network_type",
        "status",
        "message",
        *[amount(a) for a in AMOUNTS],
    )


def individual_deductible(requests: DataFrame, balances: DataFrame) -> DataFrame:
    return cell_lookup(requests, balances, "deductible", "individual")


def family_deductible(requests: DataFrame, balances: DataFrame) -> DataFrame:
    return cell_lookup(requests, balances, "deductible", "family")


def out_of_pocket_maximum(requests: DataFrame, balances: DataFrame) -> DataFrame:
    return cell_lookup(requests, balances, "out_of_pocket")


def balances_of(deductibles: DataFrame, member_id: str, plan_year: int) -> DataFrame:
    """Long-form rows of one member and year from the balance table."""
    if not member_id or not member_id.strip():
        raise ValueError("member_id cannot be empty")
    if isinstance(plan_year, bool) or not isinstance(plan_year, int) or not YEARS[0] <= plan_year <= YEARS[1]:
        raise ValueError(f"plan_year must be a valid integer between {YEARS[0]} and {YEARS[1]}")
    return deductibles.where((F.col("member_id") == member_id.strip()) & (F.col("plan_year") == plan_year))


def routine_balances(callers: DataFrame) -> DataFrame:
    """Routine rows for each caller (member_id): eight for the routine's own
    member, none for any other. The year plays no part."""
    kinds = ("deductible_type", "coverage_level", "network_type")
    amounts = ("limit_amount", "used_amount", "remaining_amount")
    rows = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in zip(kinds, row)],
                *[F.lit(v).cast(MONEY).alias(a) for a, v in zip(amounts, row[len(kinds) :])],
            )
            for row in ROUTINE_ROWS
        ]
    )
    return callers.where(F.col("member_id") == ROUTINE_MEMBER).select("member_id", F.inline(rows))
