"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words. Sources ordered by code point
(null last) weigh 1, 2, 3, 1, ... and share all words by weight; a source stops
at three times its size, and what it leaves is shared by weight among the rest
until none is above. Every document of a source is expected ``target / size of
the source`` times. Expected copies are summed along the documents of a source,
one random offset is added, and a document is emitted once for each whole
number that its part of the sum crosses.

The order is by size class, then by a hash of ``doc_id``, so each class is
sampled evenly and the words taken come near the target. Sums run in two
levels: a cell is one slice of one size class of one source, and a source of
any size is spread over 16^``digits`` cells a class. Expected copies are whole
numbers of 2^-24, so sums are exact and reruns agree.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, checkpointed, free_name

# Fixed values of the mix.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
UNIT = 1 << 24


def word_count(text: Column) -> Column:
    """Words of ``text``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``target`` of each source from ``source``, ``source_size``, ``weight``.

    Each round gives the words that are left to the sources below their limit;
    those that pass it stop there and leave the next round. Only three sums a
    round reach the driver.
    """
    sizes = checkpointed(sizes)
    limit = F.lit(MOST_COPIES) * F.col("source_size")
    words = sizes.agg(F.sum("source_size")).first()[0] or 0
    spent, stopped = 0, -1
    share_by = sizes.agg(F.sum("weight")).first()[0] or 0
    # A source is above its limit as long as  weight * left / weights >= 3 * size.
    while True:
        above = limit * F.lit(share_by) <= F.col("weight") * F.lit(words - spent)
        state = sizes.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if state[0] == stopped:
            break
        stopped, spent, share_by = state[0], state[1] or 0, state[2] or 0
    share = F.col("weight") * F.lit(words - spent).cast("double") / F.lit(share_by or 1).cast("double")
    return sizes.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def ranked_weights(sizes: DataFrame) -> DataFrame:
    """``weight`` by the place of each source in code-point order, null last.

    Sources are dealt into ranges of names of like size; a place is the number
    of sources in the ranges before and the place in its own, so that no task
    holds all sources, however much their names are alike.
    """
    order = F.col("source").asc_nulls_last()
    ranges = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are drawn by a sample, so the numbers of one run are kept.
    dealt = checkpointed(sizes.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id()))
    heads = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(order)
    placed = dealt.withColumn("place", F.row_number().over(inside)).join(heads, "range")
    place = F.col("before") + F.col("place") - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    return placed.select("key", "source_size", weight.cast("long").alias("weight"))


def _size_class(size: Column) -> Column:
    """Four classes for each doubling of the size, in whole numbers."""
    bits = F.length(F.bin(size))
    return (bits * 4 + F.call_function("div", size * 4, F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1)) - 4).cast("int")


def mixed(docs: DataFrame, seed: int = 7, digits: int = 2) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Expects ``doc_id``, ``text``, ``source``; all columns of ``docs`` are kept,
    and a new column whose name is taken gets underscores before it. Null and
    empty texts have size 0 and are taken with no words. A null source is a
    source of its own. Rows that repeat a ``doc_id`` are rows of their own; if
    all their columns are equal it does not matter which is which. An empty
    table gives an empty table.
    """
    given = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    source, doc_id, text = (F.col(given[c]) for c in ("source", "doc_id", "text"))
    own = docs.toDF(*given.values()).withColumns(
        {
            "size": word_count(text),
            "key": F.coalesce(F.concat(F.lit("="), source), F.lit("")),
            "tie": F.md5(text),
            # Rows without an id are spread by their texts.
            "spread": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(text)))),
        }
    )
    own = own.withColumns({"class": _size_class(F.col("size")), "slice": F.substring("spread", 1, digits)})
    cells = checkpointed(
        own.groupBy("key", source.alias("source"), "class", "slice").agg(
            F.sum("size").alias("words"), F.count("*").alias("rows")
        )
    )
    sizes = cells.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    each = F.when(
        F.col("source_size") > 0,
        F.least(F.round(F.col("target") / F.col("source_size") * UNIT).cast("long"), F.lit(MOST_COPIES * UNIT)),
    ).otherwise(F.lit(0).cast("long"))
    plan = source_targets(ranked_weights(sizes)).select("key", "source_size", "target", each.alias("each"))
    before = Window.partitionBy("key").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        "key", "class", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    ).join(plan, "key")
    inside = Window.partitionBy("key", "class", "slice").orderBy("spread", doc_id.asc_nulls_last(), "tie")
    # The sum before a row and with it, moved by the offset of its source; the
    # whole numbers between them are its copies.
    drawn = F.md5(F.concat_ws(":", F.lit(f"{seed}:offset"), F.col("key")))
    offset = F.conv(F.substring(drawn, 1, 6), 16, 10).cast("long")
    upto = (F.col("rows_before") + F.col("place")) * F.col("each") + offset
    copies = F.shiftright(upto, UNIT.bit_length() - 1) - F.shiftright(upto - F.col("each"), UNIT.bit_length() - 1)
    placed = own.withColumn("place", F.row_number().over(inside)).join(starts, ["key", "class", "slice"])
    placed = placed.withColumn("copies", copies)
    new = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "copies": F.col("copies"),
        "taken": F.col("copies") * F.col("size"),
    }
    return placed.select(
        *(F.col(g).alias(c) for c, g in given.items()), *(v.alias(free_name(docs, k)) for k, v in new.items())
    )


def emitted(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the
    columns of ``docs``."""
    plan = mixed(docs, seed)
    copies = F.col(plan.columns[len(docs.columns) + 3])
    repeated = plan.where(copies > 0).select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(free_name(docs, "copy"))
    )
    return repeated.select(*docs.columns)
