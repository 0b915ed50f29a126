"""Member verification by whichever identifiers are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators.spread import lookup_join, slice_of

# The texts of a verification.
NO_IDENTIFIER = "At least one identifier required"
NO_MATCH = "Authentication failed"

# How many parts the names are cut into that one name text meets.
PATTERN_SLICES = 16


def member_rows(members: DataFrame) -> DataFrame:
    """member_id, name, dob (as text) of a member table, whose birth date may
    be called ``dob`` or ``date_of_birth``."""
    dob = "dob" if "dob" in members.columns else "date_of_birth"
    return members.select(
        "member_id", names.full_name("first_name", "last_name").alias("name"), F.col(dob).cast("string").alias("dob")
    )


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _folded(c: Column, any_case: bool) -> Column:
    return F.collate(c, "UNICODE_CI_AI") if any_case else c


def members_by_key(members: DataFrame, any_case: bool = False) -> DataFrame:
    """Members under every key that can find them: (k_id, k_dob) with both
    values, the id alone, or the date alone, "" for the value not used.

    One row per key: of several members the one with the smallest id (then
    birth date, then name).
    """
    person = member_rows(members)
    member_id, dob = _text("member_id"), _text("dob")
    key = lambda i, d: F.struct(i.alias("k_id"), d.alias("k_dob"))
    both, id_only, date_only = key(member_id, dob), key(member_id, F.lit("")), key(F.lit(""), dob)
    keys = (
        F.when(member_id == "", F.array(date_only)).when(dob == "", F.array(id_only)).otherwise(F.array(both, id_only, date_only))
    )
    listed = person.select(F.explode(keys).alias("k"), F.struct("member_id", "dob", "name").alias("m"))
    return (
        listed.select(_folded(F.col("k.k_id"), any_case).alias("k_id"), F.col("k.k_dob").alias("k_dob"), "m")
        .where("k_id <> '' OR k_dob <> ''")
        .groupBy("k_id", "k_dob")
        .agg(F.min("m").alias("m"))
        .select("k_id", "k_dob", "m.*")
    )


def match_members(
    requests: DataFrame, keyed: DataFrame, keep: tuple[str, ...] = (), any_case: bool = False
) -> DataFrame:
    """Requests (request_id, member_id, dob and the columns to ``keep``) with
    the member `members_by_key` lists under the identifiers they have. Each
    request has one key, so the match is one equi-join."""
    asked = requests.select(
        "request_id",
        *keep,
        _folded(_text("member_id"), any_case).alias("k_id"),
        _text("dob").alias("k_dob"),
    )
    none_given = (F.col("k_id") == "") & (F.col("k_dob") == "")
    valid = F.coalesce("found", F.lit(False))
    matched = lookup_join(asked, keyed.withColumn("found", F.lit(True)), ["k_id", "k_dob"], ["request_id"])
    message = F.when(none_given, F.lit(NO_IDENTIFIER)).when(~valid, F.lit(NO_MATCH))
    return matched.select(
        "request_id",
        *keep,
        valid.alias("valid"),
        *[c for c in keyed.columns if c not in ("k_id", "k_dob")],
        message.alias("message"),
    )


def verify_members(requests: DataFrame, members: DataFrame, any_case: bool = False) -> DataFrame:
    """Verify requests (request_id, member_id, dob) on the identifiers they
    have; both must agree when both are given."""
    return match_members(requests, members_by_key(members, any_case), any_case=any_case).select(
        "request_id", "valid", "member_id", "name", "dob", "message"
    )


def verify_member(
    members: DataFrame, member_id: str | None = None, dob: str | None = None, need_both: bool = False
) -> DataFrame:
    """`verify_members` for one caller; the tests reach the scan."""
    if need_both and not (member_id and dob):
        raise ValueError("member_id and dob are required")
    if not member_id and not dob:
        raise ValueError(NO_IDENTIFIER)
    rows = members
    if member_id:
        rows = rows.where(F.col("member_id") == member_id)
    person = member_rows(rows)
    if dob:
        person = person.where(F.col("dob") == dob)
    return person.orderBy("member_id", "dob", "name").limit(1)


def _longest_run(pattern: Column) -> Column:
    """The longest stretch of a LIKE text without wildcards, "" without any."""
    runs = F.transform(F.split(pattern, r"[%_\\]+"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.array_max(runs)["r"]


def _pieces(text: Column, length: Column) -> Column:
    """The parts of a text that have a given length."""
    last = F.length(text) - length + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, length))
    none = F.array().cast("array<string>")
    return F.when(length == 0, F.array(F.lit(""))).when(last < 1, none).otherwise(F.array_distinct(cut))


def name_matches(requests: DataFrame, members: DataFrame, any_case: bool = False) -> DataFrame:
    """Distinct (dob, member_name) of requests for which some member born that
    day has a name LIKE ``%member_name%``; wildcards in the text count.
    ``any_case`` ignores case, but not accents, which LIKE cannot.

    Names are cut into pieces of the lengths that the texts of their date have
    (few per date), and a text meets only the names that hold its longest
    plain stretch: for a text without wildcards, exactly those that match. The
    names of one piece are spread over slices, and each slice stops at the
    first match.
    """
    # An escape before a plain character stands for that character.
    fold = F.lower if any_case else F.col
    text = F.regexp_replace(fold("member_name"), r"(?<!\\)\\(?![%_\\]|$)", "")
    asked = (
        requests.where("member_name IS NOT NULL AND dob IS NOT NULL")
        .select("dob", "member_name")
        .distinct()
        .select(
            "dob",
            "member_name",
            _longest_run(text).alias("piece"),
            F.concat(F.lit("%"), text, F.lit("%")).alias("pattern"),
        )
    )
    lengths = asked.groupBy("dob").agg(F.collect_set(F.length("piece")).alias("lengths"))
    people = member_rows(members).where("name IS NOT NULL AND dob IS NOT NULL")
    people = people.select("dob", fold("name").alias("name")).distinct()
    pieces = F.flatten(F.transform("lengths", lambda n: _pieces(F.col("name"), n)))
    held = lookup_join(people, lengths, ["dob"], ["name"], how="inner").select(
        "dob", "name", slice_of("name", slices=PATTERN_SLICES).alias("_part"), F.explode(pieces).alias("piece")
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit(PATTERN_SLICES - 1)))
    a, h = asked.withColumn("_part", parts).alias("a"), held.alias("h")
    same = (
        (F.col("a.dob") == F.col("h.dob"))
        & (F.col("a.piece") == F.col("h.piece"))
        & (F.col("a._part") == F.col("h._part"))
        & F.like("h.name", F.col("a.pattern"))
    )
    return a.join(h, same, "left_semi").select("dob", "member_name").distinct()


def verify_in_two_stages(
    requests: DataFrame, members: DataFrame, show_name_only: bool = False, any_case: bool = False
) -> DataFrame:
    """Verify requests (request_id, member_id, dob, member_name) by id and
    date, then by name and date. ``any_case`` ignores case and, in ids, accents.

    A request that only the name verifies has no row, as the answer is read by
    id and date; ``show_name_only`` gives it one, status ``verified_by_name``.
    """
    person = member_rows(members).where("member_id IS NOT NULL AND dob IS NOT NULL")
    exact = (
        person.groupBy(_folded(F.col("member_id"), any_case).alias("k_id"), "dob")
        .agg(F.min(F.struct("name")).alias("m"))
        .select("k_id", "dob", "m.name", F.lit(True).alias("exact"))
    )
    asked = requests.select(
        "request_id", "member_id", "dob", "member_name", _folded(F.col("member_id"), any_case).alias("k_id")
    )
    first = lookup_join(asked, exact, ["k_id", "dob"], ["request_id"])
    hit = F.coalesce("exact", F.lit(False))
    by_name = name_matches(first.where(~hit), members, any_case).withColumn("by_name", F.lit(True))
    both = lookup_join(first, by_name, ["dob", "member_name"], ["request_id"], keys=asked)
    name_hit = ~hit & F.coalesce("by_name", F.lit(False))
    status = F.when(hit, F.lit("verified")).when(name_hit, F.lit("verified_by_name")).otherwise(F.lit("invalid"))
    shown = both.select(
        "request_id",
        F.when(hit, F.col("member_id")).alias("member_id"),
        "name",
        F.when(hit, F.col("dob")).alias("date_of_birth"),
        status.alias("status"),
    )
    return shown if show_name_only else shown.where("status <> 'verified_by_name'")
