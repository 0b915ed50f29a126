"""Joins and numbering that stay even when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# How many slices the rows of one key are cut into, a power of two.
SLICES = 64

# Length of the hash prefix used to number groups: 4 hex digits are at most
# 65,536 buckets, whatever the size of the data.
PREFIX = 4


def slice_of(*columns: Column | str, slices: int = SLICES) -> Column:
    """A stable slice number from columns that differ within a hot key. It is
    never NULL, so joins on it add no test to either side."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(slices - 1)).cast("int")


def hash_bucket(key: str) -> Column:
    return F.coalesce(F.left(F.col(key), F.lit(PREFIX)), F.lit(""))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    keys: DataFrame | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which has at most one row per key.

    The facts of one key are cut into slices by ``spread_by``. The lookup row
    is first joined to the distinct (key, slice) pairs, at most ``slices`` per
    key, and the big join then runs on key and slice, so no task gets a whole
    hot key. Key columns must not be NULL where a match is wanted.

    The pairs are read from ``keys`` when given: a cheaper table with the same
    key and spread columns, of which the facts are a part.
    """
    cut = slice_of(*spread_by, slices=slices)
    sliced = facts.withColumn("_slice", cut)
    wanted = (facts if keys is None else keys).select(*on, cut.alias("_slice")).distinct()
    found = wanted.join(lookup, on)
    return sliced.join(found, [*on, "_slice"], how).drop("_slice")


def number_hashes(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Number the distinct values of a hash column 1, 2, ... in hash order.

    ``rows`` may repeat a hash a bounded number of times. Ranks are taken
    inside prefix buckets, which a hash fills evenly; the offsets of the
    buckets are at most 65,536 rows, small enough to broadcast.
    """
    ranked = rows.withColumn("_bucket", hash_bucket(key)).withColumn(
        "_rank", F.dense_rank().over(Window.partitionBy("_bucket").orderBy(key)).cast("long")
    )
    # All columns are read here too: the shuffle below is then the same one.
    last = F.max(F.struct("_rank", *rows.columns))
    sizes = ranked.groupBy("_bucket").agg(last["_rank"].alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranked.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )
