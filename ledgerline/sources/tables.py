"""Catalog and JDBC tables: parameterised reads, routines, counts, columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """A SELECT with named parameters. Errors are raised, not turned into an
    empty result."""
    return spark.sql(sql, args=params or {})


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A database table; with a partition column and its bounds it is read in
    parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


class Routines:
    """Named routines: each builds a DataFrame from positional parameters."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, routine: Callable[..., DataFrame]) -> None:
        self._known[name] = routine

    def call(self, name: str, params: Iterable[Any] = ()) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"no routine named {name}")
        return self._known[name](*params)

    def call_with_status(self, name: str, params: Iterable[Any] = ()) -> tuple[str, DataFrame]:
        """``success`` and the rows, or ``not_found`` when there are none."""
        rows = self.call(name, params)
        return ("not_found" if rows.isEmpty() else "success"), rows


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table, by name; a table that does not exist (None) counts 0."""
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
        if df is not None
    ]
    absent = [name for name, df in tables.items() if df is None]
    if absent:
        spark = SparkSession.active()
        counted.append(spark.createDataFrame([(n, 0) for n in absent], "table string, rows long"))
    return reduce(DataFrame.unionByName, counted).orderBy("table")


def catalog_counts(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    """`table_counts` over catalog tables that may be missing."""
    return table_counts({t: spark.table(t) if spark.catalog.tableExists(t) else None for t in tables})


def describe(spark: SparkSession, table: str) -> list[tuple[str, str, str | None]]:
    """Name, declared type and comment of each column of a catalog table."""
    listed = []
    for row in spark.sql(f"DESCRIBE TABLE {table}").collect():
        # What follows repeats the partition columns.
        if not row.col_name or row.col_name.startswith("#"):
            break
        listed.append((row.col_name, row.data_type, row.comment))
    return listed


def has_columns(spark: SparkSession, table: str, wanted: Iterable[str]) -> dict[str, bool]:
    present = {name for name, _, _ in describe(spark, table)}
    return {w: w in present for w in wanted}


def create_database(spark: SparkSession, name: str) -> None:
    quoted = name.replace("`", "``")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{quoted}`")


def append_rows(rows: DataFrame, table: str) -> int:
    """Append to a catalog table, created on first use; returns the count,
    which the writing job itself observes."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").format("parquet").saveAsTable(table)
    return int(seen.get.get("rows", 0))


def append_jdbc(rows: DataFrame, url: str, table: str, batch_size: int = 2000, **options: str) -> None:
    """Append to a database table in batches of ``batch_size`` rows per task."""
    rows.write.mode("append").format("jdbc").options(
        url=url, dbtable=table, batchsize=batch_size, **options
    ).save()
