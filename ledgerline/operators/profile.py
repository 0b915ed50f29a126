"""Column profiles of CSV files: type flags, chosen types, table definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import names, value_types

FLAGS = {
    "is_int": value_types.is_integer,
    "is_float": value_types.is_float,
    "is_bool": value_types.is_boolean,
    "is_date": value_types.is_date,
    "is_datetime": value_types.is_datetime,
}
_BIT = {flag: 1 << k for k, flag in enumerate(FLAGS)}
_FILLED = 1 << len(FLAGS)
_ALL = 2 * _FILLED - 1


def cell_mask(v: Column) -> Column:
    """What a trimmed value can be: a bit for each of `FLAGS`, and one for a
    value that is not blank. A blank can be anything; NULL has no mask.

    The bits of a set of values are the AND of their masks, so profiles of
    parts of a file merge. Kinds exclude each other but for integers, which are
    floats, and 0 and 1, which are booleans too: a value is tested once.
    """
    bits = lambda *flags: F.lit(_FILLED + sum(_BIT[f] for f in flags))
    whole = F.when(v.isin("0", "1"), bits("is_int", "is_float", "is_bool")).otherwise(bits("is_int", "is_float"))
    kinds = F.when(v == "", F.lit(_ALL - _FILLED)).when(FLAGS["is_int"](v), whole)
    for flag in ("is_date", "is_datetime", "is_bool", "is_float"):
        kinds = kinds.when(FLAGS[flag](v), bits(flag))
    return F.when(v.isNotNull(), kinds.otherwise(F.lit(_FILLED)))


def _told(mask: Column, width: Column) -> list[Column]:
    """The columns of a profile from the AND of the masks and the largest width."""
    mask = F.coalesce(mask, F.lit(_ALL))
    flags = [(mask.bitwiseAND(F.lit(bit)) != 0).alias(flag) for flag, bit in _BIT.items()]
    return [*flags, F.coalesce(width, F.lit(0)).alias("max_len"), (mask.bitwiseAND(F.lit(_FILLED)) == 0).alias("nullable")]


def profile_columns(cells: DataFrame) -> DataFrame:
    """One row per column of each file, from rows (file, ordinal, name, value).

    A flag is true when every value passes its test; blanks pass all of them
    and make the column nullable. A NULL value is a missing cell: it names the
    column and counts for nothing else.
    """
    trimmed = cells.select("file", "ordinal", "name", names.strip("value").alias("v"))
    masked = trimmed.select("file", "ordinal", "name", cell_mask(F.col("v")).alias("mask"), F.length("v").alias("width"))
    folded = masked.groupBy("file", "ordinal", "name").agg(F.bit_and("mask").alias("mask"), F.max("width").alias("width"))
    told = folded.select("file", "ordinal", "name", *_told(F.col("mask"), F.col("width")))
    return told.withColumn("name", names.strip("name")).withColumn("snake", names.snake_case("name"))


def profile_rows(table: DataFrame, file: str, headers: list[str] | None = None) -> DataFrame:
    """The profile of one file from its rows as text columns, as
    `profile_columns` gives it, the columns named by ``headers`` or as they
    are; a table without rows has all columns too.

    Cells become rows of (ordinal, value) inside a task, so that one short
    piece of generated code, which the JVM compiles, serves all columns; a task
    hands on one record a column.
    """
    cells = [F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(table.columns)]
    trimmed = table.select(F.inline(F.array(*cells))).select("ordinal", names.strip("value").alias("v"))
    masked = trimmed.select("ordinal", cell_mask(F.col("v")).alias("mask"), F.length("v").alias("width"))
    folded = masked.groupBy("ordinal").agg(F.bit_and("mask").alias("mask"), F.max("width").alias("width"))
    found = F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct("mask", "width")))).alias("found")
    shown = []
    for i, name in enumerate(headers or table.columns):
        seen = F.try_element_at("found", F.lit(i))
        shown.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("name"), seen["mask"].alias("mask"), seen["width"].alias("width")))
    stacked = folded.agg(found).select(F.inline(F.array(*shown)))
    told = stacked.select(F.lit(file).alias("file"), "ordinal", "name", *_told(F.col("mask"), F.col("width")))
    return told.withColumn("name", names.strip("name")).withColumn("snake", names.snake_case("name"))


def with_types(profile: DataFrame) -> DataFrame:
    """Add the recommended ``column_type`` to a profile."""
    return profile.withColumn("column_type", value_types.column_type())


def table_definitions(
    profile: DataFrame, dialect: str = "mysql", by: str = "table_name", name: Column | None = None
) -> DataFrame:
    """One ``CREATE TABLE IF NOT EXISTS`` text per value of ``by``, which is
    the table's name unless ``name`` derives another from it.

    Lines are gathered per table, as many as the table has columns.
    """
    typed = with_types(profile)
    nullable = F.col("nullable")
    if dialect == "mysql":
        kind, tail = F.col("column_type"), ") ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"
        null_text = F.when(nullable, F.lit("NULL")).otherwise(F.lit("NOT NULL"))
    elif dialect == "spark":
        # File tables do not keep NOT NULL, so it is kept as a comment.
        kind, tail = value_types.spark_type(F.col("column_type")), ") USING parquet"
        null_text = F.when(nullable, F.lit("")).otherwise(F.lit("COMMENT 'NOT NULL'"))
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    line = F.rtrim(F.concat(F.lit("  `"), "snake", F.lit("` "), kind, F.lit(" "), null_text))
    body = typed.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("text")))).alias("lines")
    )
    return body.select(
        by,
        F.concat(
            F.lit("CREATE TABLE IF NOT EXISTS `"),
            F.col(by) if name is None else name,
            F.lit("` (\n"),
            F.array_join(F.transform("lines", lambda x: x["text"]), ",\n"),
            F.lit("\n" + tail),
        ).alias("ddl"),
    )


def cells_of(table: DataFrame, file: str) -> DataFrame:
    """Rows (file, ordinal, name, value) of a table of text columns."""
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.col(f"`{c}`").alias("value"))
        for i, c in enumerate(table.columns)
    ]
    return table.select(F.lit(file).alias("file"), F.inline(F.array(*cells)))
