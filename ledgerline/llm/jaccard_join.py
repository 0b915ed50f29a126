"""Exact Jaccard similarity join of word n-gram sets, by partitioning the universe.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most
``k = (a + b)(1 - t)/(1 + t)`` elements. A size band hashes every element into
one of m segments, so of the m parts of two linked sets at least ``m - k`` are
equal: a set is indexed by hashes of its segment subsets, and linked sets share
some. Bands overlap so that any two sizes that can link share one. The small
band, where k is 1, has one segment and is indexed by the set and by all sets
with one element less instead.

Cost decides what is indexed. The choice between segments and neighbourhoods is
the one with fewer entries. Segments are many and small, and a set needs no more
than ``k + 1`` of its subsets: it leaves out the empty ones, and after all
entries are counted it drops its most frequent ones until so many are left. The
parts of passages that many texts share go that way. The order by cost is the
same for all sets, so the cheapest subset that two linked sets share is never
dropped by either.

Sets that meet are compared exactly. Equal sets are one class from the start.
In a group that shares a subset every class is first compared with a few
others; classes that are connected by then are not compared again, and whatever
is left is compared in full in blocks of bounded size, so no link between
components is lost, and a large group of near copies is never written as pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE_BYTES, WORD, Forest, batches, checkpointed, components, free_name, staged

WORDS = 5
# The threshold as a fraction of whole numbers: 100 * intersection >= 80 * union.
SHARE, WHOLE = 80, 100
# A band reaches from its lowest size to about so many times it.
SPREAD = 2.0
SMALL = 8  # the upper end of the first band
PART = 2.0  # elements that a segment of the largest sets of a band has on average
BLOCK = 512  # sets of a block in a full comparison
RUN = 1 << 20  # bytes of a text that are cut into words at once

_WHITE = np.zeros(256, bool)
_WHITE[list(SPACE_BYTES)] = True
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _C1) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP)]), dtype=np.uint64)


def _word_hashes(data: bytes) -> np.ndarray:
    values = np.frombuffer(data, np.uint8)
    solid = ~_WHITE[values]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    before = np.diff(np.concatenate([[0], starts, [len(values)]]))
    place = np.maximum(0, np.arange(len(values)) - np.repeat(np.concatenate([starts[:1], starts]), before))
    powers = _powers(1 << max(10, int(place.max() + 1).bit_length()))
    weighed = np.where(solid, _BYTES[values] * powers[place], np.uint64(0))
    return mix(np.add.reduceat(weighed, starts) + (ends - starts).astype(np.uint64) * _C1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in lower case (A to Z only)."""
    found, at = [], 0
    text = text.lower()
    while at < len(text):
        end = min(len(text), at + RUN)
        while end < len(text) and text[end] not in SPACE_BYTES:
            end += 1
        found.append(_word_hashes(text[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of 64-bit hashes of word n-grams; a text of fewer words
    has one of them all, one without words none."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = total * _STEP + w[k : k + len(total)]
    return np.unique(mix(total + np.uint64(n)))


def class_key(found: np.ndarray) -> int:
    """One number for a set; equal sets have the same. Sets of a corpus of n
    classes share one by chance with probability n^2 / 2^65."""
    if not len(found):
        return 0
    both = mix(np.array([found.sum() + np.uint64(len(found)), np.bitwise_xor.reduce(mix(found + _C1))], np.uint64))
    return int((both[:1] * _C1 + both[1:]).view(np.int64)[0])


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (WHOLE - SHARE) // (WHOLE + SHARE)


def widest(a: int) -> int:
    """The largest size that a set of size a can link with."""
    return a * WHOLE // SHARE


@lru_cache(maxsize=4096)
def bands(size: int) -> tuple[tuple[int, int, int], ...]:
    """(number, upper size, segments) of the bands that hold a size; 0 segments
    stand for the set and its one-deletion neighbourhood."""
    found, number, low, high = [], 0, 1, SMALL
    while low <= size:
        if size <= high:
            found.append((number, high, _segments(high)))
        number, low = number + 1, high * SHARE // WHOLE + 1
        high = max(int(low * SPREAD), low + 1)
    return tuple(found)


def _segments(high: int) -> int:
    """The cheaper allocation for a band up to size ``high``."""
    k = most_apart(high, high)
    # One-deletion needs a segment for each two differences, and an entry for each element.
    neighbours = math.ceil((k + 1) / 2) + high
    segments = math.ceil(high / PART) + 2
    return 0 if k <= 1 and neighbours <= 2 * segments else segments


def entries(found: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The index entries of a set for each of its bands, and how many of them,
    the most frequent, it may drop. The lowest bit of an entry has the parity
    of its band."""
    size, out = len(found), []
    if widest(size) == size:
        return out  # so small that only equal sets link
    mixed = mix(found * _C3 + _C1)
    for number, high, segments in bands(size):
        salt = mix(np.array([number], np.uint64) * _C1 + _C2)
        if not segments:
            whole = mixed.sum()
            some = np.concatenate([[whole], whole - mixed]) if size > 4 else np.array([whole], np.uint64)
            some, spare = mix(some ^ salt), 0
        else:
            part = ((mixed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            ordered = part[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            some = mix(np.add.reduceat(mix(mixed[order] + _C2), first) ^ mix(ordered[first] * _C3 + salt))
            need = most_apart(size, min(widest(size), high)) + 1
            spare = max(0, len(some) - need)
            if len(some) < need:  # empty segments cost most; here some are needed, the first ones
                absent = np.setdiff1d(np.arange(segments, dtype=np.uint64), ordered)[: need - len(some)]
                some = np.concatenate([some, mix(absent * _C3 + salt + _C2)])
        out.append(((some & ~np.uint64(1)) | np.uint64(number & 1), spare))
    return out


_KEYS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "cls", "even", "odd")])
_ENTRIES = pa.schema([("sig", pa.int64()), ("cls", pa.int64())])
_SETS = pa.schema([("cls", pa.int64()), ("tokens", pa.binary())])


def _texts(part, k: int):
    return ((i, t.as_py() or b"") for i, t in zip(part.column(0).to_pylist(), part.column(k), strict=True))


def _keys(parts):
    def rows():
        for part in parts:
            for doc_id, text in _texts(part, 1):
                found = shingles(text)
                spare = {int(some[0]) & 1: n for some, n in entries(found)}
                yield doc_id, len(found), class_key(found), spare.get(0, 0), spare.get(1, 0)

    yield from batches(_KEYS, rows())


def _index(parts):
    """The entries of each class that a task sees, once."""
    seen: set[int] = set()
    for part in parts:
        held, weight = [], 0
        for _, text in _texts(part, 1):
            found = shingles(text)
            key = class_key(found)
            if not len(found) or key in seen:
                continue
            if len(seen) > 2_000_000:
                seen.clear()  # a class that comes again is only indexed again
            seen.add(key)
            some = [e for e, _ in entries(found)]
            if not some:
                continue
            some = np.concatenate(some)
            held.append((some, np.full(len(some), key, np.int64)))
            weight += len(some)
            if weight > 200_000:
                yield _entry_batch(held)
                held, weight = [], 0
        if held:
            yield _entry_batch(held)


def _entry_batch(held: list) -> pa.RecordBatch:
    sig, cls = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls)], schema=_ENTRIES)


def _sets(parts):
    def rows():
        for part in parts:
            for _, text in _texts(part, 1):
                found = shingles(text)
                yield class_key(found), found.tobytes()

    yield from batches(_SETS, rows(), lambda r: len(r[1]))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """The exact test of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    if WHOLE * len(one) < SHARE * len(two):
        return False
    at = np.searchsorted(two, one)
    common = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return WHOLE * common >= SHARE * (len(one) + len(two) - common)


def _verify(parts):
    for part in parts:
        one, two = ([np.frombuffer(t.as_buffer(), np.uint64) for t in part.column(c)] for c in ("ta", "tb"))
        found = [linked(x, y) for x, y in zip(one, two, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found, pa.bool_())], schema=_PAIRS)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``linked``."""
    one = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify, "a long, b long, linked boolean")


def _met(slim: DataFrame, index: DataFrame) -> DataFrame:
    """``sig``, ``cls``, ``n`` of the entries that more than one class has,
    without the most frequent ones of each class."""
    every = Window.partitionBy("sig")
    shared = staged(
        index.withColumns({"low": F.min("cls").over(every), "high": F.max("cls").over(every)})
        .where("low != high")
        .select("sig", "cls"),
        "shared",
    ).distinct()
    sizes = slim.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "even", "odd")])
    counts = shared.groupBy("sig").agg(F.count("*").alias("c"))
    told = shared.join(counts, "sig").join(sizes, "cls")
    parity = F.col("sig").bitwiseAND(1)
    rank = F.row_number().over(Window.partitionBy("cls", parity).orderBy(F.desc("c"), "sig"))
    kept = told.withColumn("rank", rank).where(F.col("rank") > F.when(parity == 0, F.col("even")).otherwise(F.col("odd")))
    kept = kept.withColumn("m", F.count("*").over(every)).where("m > 1")
    return staged(kept.select("sig", "cls", "n"), "met")


def _sizes_fit(a, b):
    return (F.lit(WHOLE) * F.least(a, b)) >= (F.lit(SHARE) * F.greatest(a, b))


def _labelled(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``met`` with the component of each class, where a group has several."""
    if groups is None:
        return met.withColumn("comp", F.col("cls"))
    own = met.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left")
    own = own.select("sig", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    mixed = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
    return own.join(mixed, "sig")


def _with_centre(own: DataFrame, order) -> DataFrame:
    """Pairs of each class and the centre of each of its groups, ``a`` < ``b``."""
    centre = own.groupBy("sig").agg(F.min(F.struct(order.alias("o"), "cls", "n", "comp")).alias("m"))
    met = own.join(centre, "sig").where((F.col("comp") != F.col("m.comp")) & _sizes_fit(F.col("n"), F.col("m.n")))
    return met.select(F.least("cls", "m.cls").alias("a"), F.greatest("cls", "m.cls").alias("b")).distinct()


def _hosted(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes of different components that share a group.

    The component with the most classes in a group is its host, and all classes
    of the group visit it. Everything that visits a host is compared there, in
    pairs of blocks, so the pairs of a group are never rows: a task gets two
    blocks of sets and gives on at most one link for each of them.
    """
    many = own.groupBy("comp").agg(F.count_distinct("cls").alias("many"))
    hosts = own.join(many, "comp").groupBy("sig").agg(F.min(F.struct(-F.col("many"), "comp")).alias("h"))
    visits = own.join(hosts, "sig").select(F.col("h.comp").alias("host"), "cls", "comp").distinct()
    visits = checkpointed(visits)
    blocks = visits.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = visits.join(blocks, "host").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    spread = placed.select("host", "cls", "comp", "block", F.explode(every).alias("other"))
    meeting = spread.select(
        "host", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "comp"
    )
    full = meeting.join(sets, "cls").select("host", "i", "j", "block", "cls", "comp", "tokens")
    return full.groupBy("host", "i", "j").applyInArrow(_meet, "a long, b long")


def _meet(table: pa.Table) -> pa.Table:
    """Links of one or two blocks, as few as connect what is linked."""
    cls, comp, block = (np.asarray(table[c]) for c in ("cls", "comp", "block"))
    found = [np.frombuffer(t.as_buffer(), np.uint64) for t in table["tokens"]]
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(len(found)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    two = len(np.unique(block)) > 1
    forest, out = Forest(), []
    for x in range(len(found)):
        low, high = np.searchsorted(flat, found[x]), np.searchsorted(flat, found[x], side="right")
        n = high - low
        spots = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[spots], minlength=len(found))
        hit = (WHOLE * common >= SHARE * (size + size[x] - common)) & (comp != comp[x])
        hit[: x + 1] = False
        if two:
            hit &= block != block[x]
        for y in np.flatnonzero(hit).tolist():
            if forest.join(int(comp[x]), int(comp[y])):
                out.append((int(cls[x]), int(cls[y])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _named(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n``, ``cls`` and ``group``, the
    name of its component among classes; both are 0 without shingles."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    slim = staged(given.mapInArrow(_keys, "doc_id long, n long, cls long, even long, odd long"), "classes")
    met = _met(slim, given.select("doc_id", "text").mapInArrow(_index, "sig long, cls long"))

    # The sets of the classes that met another, each from one of its documents.
    wanted = met.select("cls").distinct()
    speakers = slim.join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("speaker"))
    heard = given.join(speakers, F.col("doc_id").eqNullSafe(F.col("speaker")), "left_semi")
    sets = staged(heard.mapInArrow(_sets, "cls long, tokens binary"), "sets").dropDuplicates(["cls"])
    sets = staged(sets.join(wanted, "cls", "left_semi"), "sets")

    # A centre for all groups alike, then one for each group, then whatever is left.
    links, groups = None, None
    for step in ("same centre", "own centre", "rest"):
        own = staged(_labelled(met, groups), "labelled")
        if own.isEmpty():
            break
        if step == "rest":
            new = _hosted(own, sets)
        else:
            centre = F.col("cls") if step == "same centre" else F.xxhash64("sig", "cls")
            new = _verified(_with_centre(own, centre), sets).where("linked").select("a", "b")
        links = staged(new if links is None else links.union(new), "links")
        groups = checkpointed(components(links))

    if groups is None:
        named = slim.withColumn("group", F.col("cls"))
    else:
        named = slim.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn(
            "group", F.coalesce("component", "cls")
        )
    return named.select("doc_id", "n", "cls", "group")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Rows link when their sets of distinct 5-word shingles have a Jaccard
    similarity of 0.8 or more; a component is named by its smallest ``doc_id``.
    A text that is null, empty or all white space has no shingles and links
    with nothing. Rows that repeat a text are one class. A null ``doc_id`` is
    never the smallest; a component without any other has a null name. Other
    columns are not looked at; an empty table gives an empty table.
    """
    named = _named(docs)
    lowest = named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("lowest"))
    return named.join(lowest, (F.col("n") > 0) & (named["group"] == lowest["group"]), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _class_of(texts: pa.Array) -> pa.Array:
    return pa.array([class_key(shingles(t.as_py())) for t in texts], pa.int64())


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one with the smallest
    ``doc_id``, null last, and of those one of the smallest class. Rows without
    shingles all stay, whatever their ``doc_id``.

    A row is known by its ``doc_id`` where no other row has it; rows with a null
    or repeated one are told apart by the class of their text.
    """
    found = staged(_named(docs).select("doc_id", "n", "cls", "group"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")).alias("first")
    kept = found.where("n > 0").groupBy("group").agg(first).select("first.doc_id", "first.cls")
    mark, key = free_name(docs, "kept_id"), free_name(docs, "kept_cls")
    stays = kept.union(found.where("n = 0").select("doc_id", "cls")).where("doc_id IS NOT NULL")
    stays = stays.select(F.col("doc_id").alias(mark))
    own = F.col("doc_id").cast("long")
    twice = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(mark)).agg(F.count("*").alias("n"))
    twice = checkpointed(twice.where("n > 1").select(mark))
    if twice.isEmpty() and found.where("doc_id IS NULL").isEmpty():
        return docs.join(stays, own == F.col(mark), "left_semi")

    alone = docs.join(stays.join(twice, mark, "left_anti"), own == F.col(mark), "left_semi")
    unclear = docs.where(own.isNull()).union(docs.join(twice, own == F.col(mark), "left_semi"))
    has_words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    classed = unclear.where(has_words).withColumn(key, F.arrow_udf(_class_of, "long")(text)).dropDuplicates(["doc_id", key])
    wanted = kept.select(F.col("doc_id").alias(mark), F.col("cls").alias(f"{key}_"))
    told = classed.join(wanted, own.eqNullSafe(F.col(mark)) & (F.col(key) == F.col(f"{key}_")), "left_semi").drop(key)
    return alone.union(unclear.where(~has_words)).union(told)
