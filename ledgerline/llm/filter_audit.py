"""What each filter of a chain removes, for every order of the filters.

A document is a set of failed filters, its mask, and an order of the filters is
a permutation. The mask matrix has 0 where a mask fails a filter and infinity
elsewhere; the position matrix is the inverse of each order, the step at which
it applies a filter. Their min-plus product is the step that removes the
documents of a mask under an order. Those steps say where to add the weights of
a mask: all documents, good ones, toxic ones; what fails a filter but went
before is redundant to it.

Spark counts documents by (part, mask), partial sums first, so a part of any
size comes down to at most one row a mask. The products are the same for all
parts; tasks apply them to blocks of parts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches, staged
from ledgerline.operators.spread import lookup_join

# The filters of the audit in the order of their bits, and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The bytes of a character after its first.
_TAIL_BYTES = bytes(range(0x80, 0xC0))

# Filters that the products are made for: 5,040 orders of 128 masks.
MOST_FILTERS = 7
# Parts whose counts are worked out together.
BLOCK = 32


def text_mask(text: bytes) -> int:
    """The bits of the failed filters that look at a text alone, A to D."""
    words = text.split()  # cuts at space and 0x09 to 0x0D
    points = len(text.translate(None, _TAIL_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MOST_CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


_FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def _facts(parts):
    rows = (
        (i, source or "", text_mask(data := text.as_py() or b""), hashlib.sha256(data).digest())
        for part in parts
        for i, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)
    )
    yield from batches(_FACTS, rows)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (bit k: fails filter k of ``FILTERS``) and
    ``n``, the number of such rows, for all rows of ``docs``.

    ``part`` is the source, an empty string if null; a null text is empty. A
    document fails E if a smaller ``doc_id`` has the same text anywhere in the
    table; rows of one ``doc_id`` do not fail by each other, and a null
    ``doc_id`` neither fails nor is smaller. Other columns are not looked at; an
    empty table gives an empty table. Texts are held one at a time and compared
    by SHA-256. Rows that repeat are counted before anything is joined, and the
    rows of one text are spread over slices.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("part"),
        F.col("text").cast("binary").alias("text"),
    )
    read = slim.mapInArrow(_facts, "doc_id long, part string, mask int, digest binary")
    facts = staged(read.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "facts")
    # Only texts under more than one id can fail.
    known = facts.where("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where(F.col("first") < F.col("last")).select("digest", "first")
    joined = lookup_join(known, firsts, on=["digest"], spread_by=["doc_id"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    bit = 1 << FILTERS.index("E")
    marked = joined.select("doc_id", "part", (F.col("mask") + copy * bit).cast("int").alias("mask"), "n")
    return marked.union(facts.where("doc_id IS NULL").select("doc_id", "part", "mask", "n"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with ``good`` and ``toxic`` (long): its ``n`` if any row of
    ``labels`` says ``quality`` 1, ``toxic`` 1 of that ``doc_id``, else 0."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = failed.where("doc_id IS NOT NULL").join(said, "doc_id", "left")
    weighed = [(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).cast("long").alias(c) for c in ("good", "toxic")]
    none = [F.lit(0).cast("long").alias(c) for c in ("good", "toxic")]
    return known.select(*failed.columns, *weighed).union(failed.where("doc_id IS NULL").select(*failed.columns, *none))


@dataclass(frozen=True)
class Products:
    """What the min-plus product says of every mask and order."""

    orders: tuple[str, ...]
    #: filter at each step of an order
    filter_at: np.ndarray
    #: step of each filter in an order
    step_of: np.ndarray
    #: step that removes a mask under an order; the number of filters if none does
    removed_at: np.ndarray
    #: mask, order, step: fails that filter and was removed before
    redundant: np.ndarray


def products(filters: str) -> Products:
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) != n:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with names of one letter each")
    filter_at = np.array(list(permutations(range(n))), np.int64)
    step_of = np.argsort(filter_at, axis=1)
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 > 0
    # Infinity is any number past the last step.
    masks = np.where(fails, 0, n)
    removed_at = np.minimum((masks[:, None, :] + step_of[None, :, :]).min(axis=2), n)
    redundant = fails[:, filter_at] & (removed_at[:, :, None] < np.arange(n))
    orders = tuple("".join(filters[f] for f in order) for order in filter_at.tolist())
    return Products(orders, filter_at, step_of, removed_at, redundant.astype(np.int64))


def scattered(weights: np.ndarray, p: Products) -> np.ndarray:
    """Weight (part, mask) removed at each (part, order, step)."""
    n_orders, n = p.filter_at.shape
    found = np.zeros((len(weights), n_orders, n + 1), np.int64)
    orders = np.arange(n_orders)
    for mask in np.flatnonzero(weights.any(axis=0)).tolist():
        found[:, orders, p.removed_at[mask]] += weights[:, mask, None]
    return found[:, :, :n]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(rows: np.ndarray, good: np.ndarray, toxic: np.ndarray, p: Products) -> dict[str, np.ndarray]:
    """Each of ``COUNTS`` by (part, order, step) from weights by (part, mask)."""
    removed = scattered(rows, p)
    by_filter = np.zeros((len(rows), p.filter_at.shape[1]), np.int64)
    for f in range(by_filter.shape[1]):
        by_filter[:, f] = np.take_along_axis(removed, p.step_of[None, :, f, None], axis=2).sum(axis=(1, 2))
    return {
        "kept": rows.sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": np.tensordot(rows, p.redundant, 1),
        "unique_fails": rows[:, 1 << p.filter_at],
        "good_lost": scattered(good, p),
        "toxic_lost": scattered(toxic, p),
        "shapley": by_filter[:, p.filter_at],
    }


def interaction_audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each step of each order of ``filters`` does to each part.

    Expects ``part``, ``mask`` (bit k: fails filter k), ``n``, ``good``,
    ``toxic`` (rows, and those of them with the label). One row for each
    ``part``, ``filter_order`` and ``step`` (from 1), zeros included: ``kept``
    after it, ``removed`` by it, ``redundant`` (fails its filter, removed
    before), ``unique_fails`` (fails its filter alone), ``good_lost``,
    ``toxic_lost`` and ``shapley`` (removed by its filter over all orders). No
    rows give no parts.
    """
    p = products(filters)
    n_masks, (n_orders, n) = 1 << len(filters), p.filter_at.shape
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in COUNTS])
    order_names = pa.array(np.repeat(np.array(p.orders, dtype=object), n), pa.string())
    steps = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), n_orders))

    def block(names: list[str], masks: list[list[dict]]) -> pa.RecordBatch:
        weights = np.zeros((3, len(names), n_masks), np.int64)
        for k, found in enumerate(masks):
            for m in found:
                weights[:, k, m["mask"]] = m["n"], m["good"], m["toxic"]
        found = interactions(*weights, p)
        many = np.tile(np.arange(n_orders * n), len(names))
        columns = [pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), n_orders * n)))]
        columns += [order_names.take(pa.array(many)), steps.take(pa.array(many))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c].reshape(-1)) for c in COUNTS)], schema=schema)

    def audit(parts):
        for part in parts:
            for k in range(0, part.num_rows, BLOCK):
                some = part.slice(k, BLOCK)
                yield block(some.column(0).to_pylist(), some.column(1).to_pylist())

    sums = failed.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    masks = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return masks.mapInArrow(audit, f"part string, filter_order string, step int, {counts}")
