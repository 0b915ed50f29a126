"""Near-duplicate vectors by tiled comparison in PCA order.

Vectors of one label are compared by cosine. Equal vectors are one class with a
count. Classes are scaled to length 1, turned into the axes of a principal
component analysis of all of them, sorted by the first axis and cut into
blocks. Two blocks are only compared if their boxes on the leading axes are
near enough for the threshold; a comparison runs in tiles, adds up the products
of the leading axes first, bounds the rest by the norms of what is left, and
drops every pair whose cosine cannot reach the threshold any more. Pairs within
rounding of the threshold are computed again from the vectors as given.

A task gives on, for each class, the number of its links, and for each linked
class the smallest class that its links reach inside the task. That is all the
components need, so the links of a large group are never written as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, staged

THRESHOLD = 0.93
BLOCK_ROWS = 2_048
TILE = 512
# Axes whose products are added before each test of the bound.
STEP = 16
# Leading axes of which a block keeps its box.
BOX = 4
NEAR = 1e-9


def usable(embedding: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct vectors of each label: ``label``, ``embedding``, ``id`` (the smallest), ``n``."""
    return vectors.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(found: DataFrame, width: int) -> np.ndarray:
    """The axes of all unit vectors of one width, strongest first, as columns.
    The sums of products, one row per pair of components, are added by Spark."""
    left, right = np.triu_indices(width)

    def products(parts):
        total = np.zeros((width, width))
        for part in parts:
            unit = _unit(_matrix(part.column(0), width))
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(total[left, right])],
            names=["i", "j", "value"],
        )

    sums = found.select("embedding").mapInArrow(products, "i int, j int, value double")
    moments = np.zeros((width, width))
    for i, j, value in sums.groupBy("i", "j").agg(F.sum("value")).collect():
        moments[i, j] = moments[j, i] = value
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("label", pa.int64()),
        ("low", pa.list_(pa.float64())),
        ("high", pa.list_(pa.float64())),
        ("ids", pa.binary()),
        ("counts", pa.binary()),
        ("data", pa.binary()),
    ]
)
_BLOCK_DDL = "block long, label long, low array<double>, high array<double>, ids binary, counts binary, data binary"


def _blocks(found: DataFrame, axes: np.ndarray, block_rows: int) -> DataFrame:
    """Classes sorted by label and first axis, in blocks of bounded size."""
    width = len(axes)
    first = axes[:, 0].tolist()

    def project(parts):
        for part in parts:
            lead = _unit(_matrix(part.column(1), width)) @ np.array(first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lead)], names=["label", "embedding", "id", "n", "lead"])

    def cut(parts):
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table):
            ids = np.asarray(table["id"])
            given = _matrix(table["embedding"].combine_chunks(), width)
            box = _unit(given) @ axes[:, :BOX]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(ids[0])], pa.int64()),
                    pa.array([table["label"][0].as_py()], pa.int64()),
                    pa.array([box.min(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([box.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([ids.tobytes()]),
                    pa.array([np.asarray(table["n"]).tobytes()]),
                    pa.array([given.tobytes()]),
                ],
                schema=_BLOCK,
            )

        def full(last: bool):
            """Blocks that are complete: of one label, and full or followed by another label."""
            nonlocal held
            while held:
                table = pa.Table.from_batches(held)
                labels = np.asarray(table["label"])
                same = int(np.searchsorted(labels, labels[0], side="right"))
                if same >= block_rows or same < len(labels) or last:
                    take = min(same, block_rows)
                    yield block(table.slice(0, take))
                    held = table.slice(take).combine_chunks().to_batches()
                else:
                    return

        for part in parts:
            if part.num_rows:
                held.append(part)
                if sum(x.num_rows for x in held) >= block_rows:
                    yield from full(False)
        yield from full(True)

    ddl = "label long, embedding array<double>, id long, n long, lead double"
    projected = found.select(F.col("label").cast("long"), "embedding", "id", "n").mapInArrow(project, ddl)
    shards = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = projected.repartitionByRange(shards, "label", "lead", "id").sortWithinPartitions("label", "lead", "id")
    return staged(ordered.mapInArrow(cut, _BLOCK_DDL), "blocks")


def _pairs(blocks: DataFrame, reach: float, box_axes: int) -> DataFrame:
    """Pairs of blocks of one label, each with itself too, whose boxes lie
    within ``reach``. Blocks meet in bins of the first axis as wide as that."""
    box = blocks.select("block", "label", "low", "high")
    at = lambda c: F.floor(c / F.lit(reach)).cast("long")
    lower = box.select("*", F.explode(F.sequence(at(F.col("low")[0]), at(F.col("high")[0]))).alias("bin")).alias("a")
    upper = box.select(
        "*", F.explode(F.sequence(at(F.col("low")[0] - reach), at(F.col("high")[0] + reach))).alias("bin")
    ).alias("b")
    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col("a.low")[k] - F.col("b.high")[k], F.col("b.low")[k] - F.col("a.high")[k]), 2)
        for k in range(box_axes)
    )
    met = lower.join(upper, ["label", "bin"]).where((F.col("a.block") <= F.col("b.block")) & (gap <= reach * reach))
    # Either side's bins hold the other's; the order of ids picks one row a pair.
    return met.select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()


def compare(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of unit vectors ``a`` and ``b`` (in PCA order) may reach
    the threshold, as row and column numbers and cosines. ``ra`` and ``rb``
    have, for each test, the norms of what is left of each vector."""
    width = a.shape[1]
    total = a[:, :STEP] @ b[:, :STEP].T
    rows, cols = np.nonzero(total + np.outer(ra[:, 0], rb[:, 0]) >= threshold - NEAR)
    value = total[rows, cols]
    for k, start in enumerate(range(STEP, width, STEP), 1):
        if not len(rows):
            break
        end = start + STEP
        value = value + np.einsum("ij,ij->i", a[rows, start:end], b[cols, start:end])
        stay = value + ra[rows, k] * rb[cols, k] >= threshold - NEAR
        rows, cols, value = rows[stay], cols[stay], value[stay]
    return rows, cols, value


def _suffix(unit: np.ndarray) -> np.ndarray:
    """Norms of what is left of each vector after each step, rounded up."""
    squares = np.cumsum((unit * unit)[:, ::-1], axis=1)[:, ::-1]
    starts = list(range(STEP, unit.shape[1], STEP))
    left = squares[:, starts] if starts else np.zeros((len(unit), 0))
    return np.concatenate([np.sqrt(left) + 1e-12, np.zeros((len(unit), 1))], axis=1)


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _linker(axes: np.ndarray, threshold: float):
    width = len(axes)

    def read(part, k):
        ids, counts = (np.frombuffer(part.column(c)[k].as_py(), np.int64) for c in ("ids", "counts"))
        return ids, counts, np.frombuffer(part.column("data")[k].as_py(), np.float64).reshape(-1, width)

    def tiles(one, two, same: bool):
        """Links of each class, and the smallest class it reaches, of a pair of blocks."""
        (ia, na, va), (ib, nb, vb) = one, two
        ua, ub = _unit(va) @ axes, _unit(vb) @ axes
        ra, rb = _suffix(ua), _suffix(ub)
        links_a, links_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        edges = []
        for i in range(0, len(ia), TILE):
            for j in range(i if same else 0, len(ib), TILE):
                rows, cols, value = compare(ua[i : i + TILE], ub[j : j + TILE], ra[i : i + TILE], rb[j : j + TILE], threshold)
                rows, cols = rows + i, cols + j
                keep = value >= threshold
                for k in np.flatnonzero(np.abs(value - threshold) <= NEAR):
                    x, y = va[rows[k]], vb[cols[k]]
                    keep[k] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
                if same:
                    keep &= rows < cols
                rows, cols = rows[keep], cols[keep]
                if len(rows):
                    np.add.at(links_a, rows, nb[cols])
                    np.add.at(links_b, cols, na[rows])
                    edges.append((rows, cols))
        return links_a, links_b, edges

    def link(parts):
        for part in parts:
            for k in range(part.num_rows):
                same = part.column("same")[k].as_py()
                one = read(part.select(["ids", "counts", "data"]), k)
                two = one if same else read(
                    part.select(["ids2", "counts2", "data2"]).rename_columns(["ids", "counts", "data"]), k
                )
                links_a, links_b, edges = tiles(one, two, same)
                if not edges:
                    continue
                ids = np.concatenate([one[0], two[0]])
                links = np.concatenate([links_a, links_b])
                left = np.concatenate([e[0] for e in edges])
                right = np.concatenate([e[1] for e in edges]) + len(one[0])
                root = ids.copy()
                if same:  # both halves are the same classes
                    right = right - len(one[0])
                    ids, links, root = one[0], links_a + links_b, one[0].copy()
                while True:  # the smallest id spreads along the links
                    low = np.minimum(root[left], root[right])
                    new = root.copy()
                    np.minimum.at(new, left, low)
                    np.minimum.at(new, right, low)
                    if (new == root).all():
                        break
                    root = new
                has = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[has]), pa.array(links[has]), pa.array(root[has])], schema=_LINKS
                )

    return link


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``label``, ``embedding``):
    ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``
    (the smallest ``vec_id`` that links reach), ``kept``.

    Vectors link when their labels are equal and not null, their widths are
    equal, and their cosine in double precision is ``threshold`` or more. A
    vector that is null, empty, all zero or has a null or non-finite component
    links with nothing, nor does one whose ``vec_id`` is null (its component is
    null and it is not kept). Rows that repeat a vector are vectors of their
    own and link with each other, and rows that repeat a ``vec_id`` with other
    vectors link as their vectors do. Other columns are not looked at; an empty
    table gives an empty table.
    """
    every = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")), F.lit(False))
    sound, rest = every.where(fit), every.where(~fit)
    # A class gets a number of its own, as the smallest vec_id of two classes can be the same.
    numbered = classes(sound).withColumnRenamed("id", "low").withColumn("id", F.monotonically_increasing_id())
    found = staged(numbered, "classes")
    widths = [r[0] for r in found.select(F.size("embedding").alias("w")).distinct().collect()]
    links = None
    for width in sorted(widths):
        some = found.where(F.size("embedding") == width)
        axes = principal_axes(some, width)
        blocks = _blocks(some, axes, block_rows)
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
        one = blocks.select(F.col("block").alias("a"), "ids", "counts", "data")
        two = blocks.select(
            F.col("block").alias("b"), *(F.col(c).alias(f"{c}2") for c in ("ids", "counts", "data"))
        )
        work = _pairs(blocks, reach, min(BOX, width)).join(one, "a").join(two, "b")
        work = work.select("ids", "counts", "data", "ids2", "counts2", "data2", (F.col("a") == F.col("b")).alias("same"))
        part = work.mapInArrow(_linker(axes, threshold), "id long, links long, root long")
        links = part if links is None else links.union(part)
    alone = rest.select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )
    if links is None:
        return alone
    own = sound.join(found.withColumnRenamed("n", "copies"), ["label", "embedding"]).select("vec_id", "id", "low", "copies")
    links = staged(links, "links")
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b"))
    lows = groups.join(found.select(F.col("id").alias("node"), "low"), "node")
    lows = lows.groupBy("component").agg(F.min("low").alias("component_low"))
    groups = groups.join(lows, "component").select(F.col("node").alias("id"), "component_low")
    component = F.coalesce("component_low", "low")
    linked = own.join(totals, "id", "left").join(groups, "id", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
    return linked.union(alone)
