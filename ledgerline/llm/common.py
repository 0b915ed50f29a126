"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_root, checkpointed

# The white space that separates words, and its form for bytes.translate.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a new folder in the folder that the whole cluster shares."""
    return f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str = "staged") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its plan
    runs once, later reads take only the columns they need, and lost
    executors cost nothing."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batches(schema: pa.Schema, rows, size_of=None, max_rows: int = 20_000, max_bytes: int = 8 << 20):
    """Record batches of bounded size from an iterator of tuples."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size_of(row) if size_of else 0
        if len(held) >= max_rows or weight >= max_bytes:
            yield _batch(schema, held)
            held, weight = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class Forest:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


_STAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(parts):
    """Edges of one task to a star per local component."""
    forest = Forest()
    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            forest.join(a, b)
            if len(forest.up) >= 1_000_000:  # bounded memory: what is known so far goes on as stars
                yield from batches(_STAR, ((x, r) for x in list(forest.up) if (r := forest.find(x)) != x))
                forest = Forest()
    yield from batches(_STAR, ((x, r) for x in list(forest.up) if (r := forest.find(x)) != x))


# Edges that one task contracts at the end; some ten megabytes.
FEW_EDGES = 300_000


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``: long, not null).

    Returns ``node`` and ``component`` (its smallest node) for every node that
    has an edge to another. Each task first contracts its edges to stars. While
    more than ``few`` are left, the large-star and small-star steps alternate,
    so that a component never has to fit in one task; so few edges, or what
    does not change any more, are contracted once more, and that is the result.
    """
    stars = checkpointed(edges.select("a", "b").mapInArrow(_contract, "a long, b long").distinct())
    state = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if mark[0] <= few:
            stars = checkpointed(stars.coalesce(1).mapInArrow(_contract, "a long, b long"))
            break
        if mark == state:
            break
        state = mark
        stars = checkpointed(_small_star(_large_star(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    larger = both.where("b > a").join(low, F.col("a") == F.col("u"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("u", "m")).where("a != b").distinct()
