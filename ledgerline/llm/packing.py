"""Packing documents into token sequences, shortest pack first over the length histogram.

A document is its token ids and an end id. Whole sequences are cut from its
front; what is left, its rest, is shorter than a sequence. Spark counts the
rests by length, so the driver sees one number a length and never a document.
There the lengths are placed longest first, all rests of a length at once: each
goes to the pack with the most space, or opens a pack if none has room. What is
kept is how many packs have a pattern, not the packs.

Where many rests have one length, packs stay with gaps. As documents may be
cut, the emptiest packs are taken apart and their rests cut to fill the gaps of
others, until less than one sequence of padding is left; gaps of a few tokens
stay, as shorter cuts would harm more than they save.

A pattern then asks for the rests of a length by rank: the place of a rest
among all of its length. A task numbers its own rests, and the numbers before
each task come from sums by (task, length), so no task holds a length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import bpe
from ledgerline.llm.common import batches, staged

END_ID = 0
CAPACITY = 1024
# Gaps of fewer tokens are padded, not filled with cuts.
LEAST_CUT = 16
# Fixed value: how byte-level tokenizers of this kind cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """The ids of whole texts under a byte-level vocabulary file. The compiled
    encoder serves vocabularies whose ids follow their merges, and gives the
    ids of the tokenizers library; a text that it refuses is encoded by
    ``bpe``."""

    def __init__(self, raw: bytes):
        self.vocab = bpe.vocabulary(raw)
        if (np.diff(self.vocab.made) <= 0).any() or self.vocab.bytes_ids.max() > self.vocab.made[0]:
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        special = self.vocab.special
        ranks = {b: i for i, b in self.vocab.text.items() if i not in special.values()}
        self.encoder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.encoder.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern gives up on a text with endless white space
            return next(bpe.Encoder(self.vocab).encode([text]))[0].astype(np.uint32)


@lru_cache(maxsize=1)
def text_ids(raw: bytes) -> TextIds:
    return TextIds(raw)


# ---- Patterns, from the histogram alone -------------------------------------------------


@dataclass
class Packs:
    """``count`` packs of one pattern with ``space`` left.

    ``whole`` lists (length, rests of that length in each pack). ``cuts`` lists
    (length, rank, from, to): the pack number k has that part of the rest whose
    rank is ``rank + k``.
    """

    count: int
    space: int
    whole: tuple[tuple[int, int], ...] = ()
    cuts: tuple[tuple[int, int, int, int], ...] = ()

    def split(self, n: int) -> tuple[Packs, Packs]:
        """The first ``n`` packs, and the others."""
        moved = tuple((length, rank + n, a, b) for length, rank, a, b in self.cuts)
        return Packs(n, self.space, self.whole, self.cuts), Packs(self.count - n, self.space, self.whole, moved)

    def with_rests(self, length: int, n: int = 1) -> Packs:
        last = self.whole[-1] if self.whole else (0, 0)
        if last[0] == length:
            whole = (*self.whole[:-1], (length, last[1] + n))
        else:
            whole = (*self.whole, (length, n))
        return Packs(self.count, self.space - n * length, whole, self.cuts)

    def with_cut(self, length: int, rank: int, a: int, b: int) -> Packs:
        return Packs(self.count, self.space - (b - a), self.whole, (*self.cuts, (length, rank, a, b)))


@dataclass
class _Open:
    """Packs by the space they have left, most first."""

    heap: list[tuple[int, int, Packs]] = field(default_factory=list)
    made: int = 0

    def put(self, packs: Packs) -> None:
        if packs.count:
            self.made += 1
            heapq.heappush(self.heap, (-packs.space, self.made, packs))

    def most(self) -> int:
        return -self.heap[0][0] if self.heap else 0

    def take(self) -> Packs:
        return heapq.heappop(self.heap)[2]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Packs]:
    """Packs for ``histogram`` (rests of each length), longest length first."""
    packs = _Open()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs.most() >= length:
                some = packs.take()
                n = min(left, some.count)
                some, others = some.split(n)
                packs.put(others)
                packs.put(some.with_rests(length))
                left -= n
            else:
                each = min(capacity // length, left)
                n = left // each
                packs.put(Packs(n, capacity).with_rests(length, each))
                left -= n * each
    return [p for _, _, p in sorted(packs.heap)]


def filled_gaps(packs: list[Packs], capacity: int, least: int) -> tuple[list[Packs], dict[int, int]]:
    """``packs`` with gaps of ``least`` tokens or more filled from the emptiest
    packs, as long as that saves whole packs; and how many rests of each length
    have been cut, which have the first ranks of their length."""
    packs = sorted(packs, key=lambda p: p.space)
    full = [p for p in packs if p.space < least]
    emptiest = [p for p in packs if p.space >= least]
    save = sum(p.count * p.space for p in emptiest) // capacity
    used: dict[int, int] = {}
    pieces: list[tuple[int, int, int, int]] = []  # length, rank, how many, from where on
    while save and emptiest:
        donor = emptiest.pop()
        n = min(save, donor.count)
        donor, others = donor.split(n)
        if others.count:
            emptiest.append(others)
        for length, each in donor.whole:
            pieces.append((length, used.get(length, 0), n * each, 0))
            used[length] = used.get(length, 0) + n * each
        save -= n
    gaps = _Open()
    for p in emptiest:
        gaps.put(p)
    while pieces:
        length, rank, n, a = pieces.pop()
        if gaps.most() < least:
            gaps.put(Packs(max(1, n * (length - a) // capacity), capacity))
        gap = gaps.take()
        some = min(n, gap.count)
        gap, others = gap.split(some)
        gaps.put(others)
        b = min(length, a + gap.space)
        gaps.put(gap.with_cut(length, rank, a, b))
        if n > some:
            pieces.append((length, rank + some, n - some, a))
        if b < length:
            pieces.append((length, rank, some, b))
    return full + [p for _, _, p in sorted(gaps.heap)], used


# Columns of a slot: the rests of ``length`` with ranks from ``low`` to ``high``
# lie ``each`` to a sequence from ``sequence`` on, with their part ``cut_from`` to ``cut_to`` at ``offset``.
SLOT = ("length", "low", "high", "each", "sequence", "offset", "cut_from", "cut_to")


def slots(histogram: dict[int, int], capacity: int = CAPACITY, least: int = LEAST_CUT) -> tuple[np.ndarray, int]:
    """The slots of all patterns (columns ``SLOT``), and the number of sequences.

    Their number depends on the lengths that there are, not on how many rests.
    """
    packs, used = filled_gaps(shortest_pack_first(histogram, capacity), capacity, least)
    rank = dict(used)
    found, sequence = [], 0
    for p in packs:
        offset = 0
        for length, each in p.whole:
            low = rank.get(length, 0)
            rank[length] = low + p.count * each
            found.append((length, low, rank[length], each, sequence, offset, 0, length))
            offset += length * each
        for length, low, a, b in p.cuts:
            found.append((length, low, low + p.count, 1, sequence, offset, a, b))
            offset += b - a
        sequence += p.count
    return np.array(found, np.int64).reshape(-1, len(SLOT)), sequence


# ---- Spark ------------------------------------------------------------------------------

_TOKENS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("task", pa.int32()),
        ("tokens", pa.int64()),
        ("rest", pa.int32()),
        ("whole_place", pa.int64()),
        ("rest_place", pa.int64()),
        ("whole_crcs", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)
_TOKENS_DDL = (
    "doc_id long, task int, tokens long, rest int, whole_place long, rest_place long, whole_crcs array<long>, ids binary"
)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, all_ids: bool = False) -> DataFrame:
    """The ids of every text and an end id, with what places them: ``task``,
    ``tokens``, ``rest`` (tokens after the whole sequences), the whole sequences
    and the rests of that length that the task had before. ``ids`` has 2 bytes
    an id where the vocabulary allows, of the rest only unless ``all_ids``."""
    with open(tokenizer, "rb") as f:
        raw = f.read()

    def encode(parts):
        encoder = text_ids(raw)
        width = "<u2" if encoder.encoder.max_token_value < 1 << 16 else "<u4"
        task = TaskContext.get().partitionId()
        wholes, rests = 0, np.zeros(capacity, np.int64).tolist()

        def rows():
            nonlocal wholes
            for part in parts:
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(END_ID))
                    whole, rest = divmod(len(ids), capacity)
                    crcs = [_crc(ids[k * capacity : (k + 1) * capacity]) for k in range(whole)]
                    kept = ids if all_ids else ids[whole * capacity :]
                    yield i, task, len(ids), rest, wholes, rests[rest], crcs, kept.astype(width).tobytes()
                    wholes += whole
                    rests[rest] += 1

        yield from batches(_TOKENS, rows(), lambda r: len(r[-1]) + 9 * len(r[-2]) + 60)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(encode, _TOKENS_DDL)


def _placed(tokens: DataFrame, capacity: int) -> DataFrame:
    """``tokens`` with the rank of each rest and of the first whole sequence.
    The window of a length has a row a task."""
    whole = F.call_function("div", F.col("tokens"), F.lit(capacity))
    by_task = tokens.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(whole).alias("whole"))
    wholes = by_task.groupBy("task").agg(F.sum("whole").alias("n")).select("task", F.lit(capacity).alias("rest"), "n")
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_task.select("task", "rest", "n").union(wholes)
    sums = sums.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rests = sums.where(F.col("rest") < capacity).withColumnRenamed("before", "rests_before")
    firsts = sums.where(F.col("rest") == capacity).select("task", F.col("before").alias("wholes_before"))
    places = tokens.join(rests.join(firsts, "task"), ["task", "rest"])
    return places.withColumns(
        {
            "rest_place": F.col("rests_before") + F.col("rest_place"),
            "whole_place": F.col("wholes_before") + F.col("whole_place"),
        }
    ).drop("rests_before", "wholes_before")


_PIECES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)


def _pieces(part: pa.RecordBatch, table: np.ndarray, packed: int, capacity: int, with_ids: bool) -> Iterator[tuple]:
    """The pieces of a batch of placed documents."""
    column = {n: part.column(k) for k, n in enumerate(part.schema.names)}
    docs, tokens = column["doc_id"].to_pylist(), column["tokens"].to_pylist()
    rest = column["rest"].to_numpy().astype(np.int64)
    place, first = column["rest_place"].to_numpy(), column["whole_place"].to_pylist()
    n_whole = [t // capacity for t in tokens]

    def ids(k: int, a: int, b: int) -> np.ndarray:
        data = column["ids"][k].as_buffer()
        have = tokens[k] if with_ids else int(rest[k])
        width = len(data) // have
        skip = 0 if with_ids else n_whole[k] * capacity
        return np.frombuffer(data, f"<u{width}", b - a, (a - skip) * width)

    def row(k: int, a: int, b: int, sequence: int, offset: int, crc: int | None = None) -> tuple:
        own = ids(k, a, b) if with_ids or crc is None else None
        crc = _crc(own) if crc is None else crc
        return docs[k], a, b - a, crc, tokens[k], sequence, offset, own.astype("<u4").tobytes() if with_ids else None

    crcs = column["whole_crcs"]
    for k in np.flatnonzero(n_whole).tolist():
        for j, crc in enumerate(crcs[k].as_py()):
            yield row(k, j * capacity, (j + 1) * capacity, packed + first[k] + j, 0, crc)
    # Slots and rests meet on one line of numbers: the length, then the rank.
    line = (rest << 44) + place
    order = np.argsort(line)
    line = line[order]
    low = np.searchsorted(line, (table[:, 0] << 44) + table[:, 1])
    high = np.searchsorted(line, (table[:, 0] << 44) + table[:, 2])
    for s in np.flatnonzero(high > low).tolist():
        length, least, _, each, sequence, offset, a, b = table[s].tolist()
        for k in order[low[s] : high[s]].tolist():
            past, within = divmod(int(place[k]) - least, each)
            start = n_whole[k] * capacity
            yield row(k, start + a, start + b, sequence + past, offset + within * length)


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST_CUT, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``start`` (ids of the document
    before it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and
    ``offset`` (its place there), and ``ids`` (4 bytes each) with ``with_ids``.

    ``tokenizer`` names a vocabulary file, read by the driver. A null text
    counts as empty and is its end id alone; rows that repeat are documents of
    their own, whatever their ids; other columns are not looked at; an empty
    table gives an empty table. Texts of any length are cut. Each id lies in one
    piece, and the pieces of a sequence lie side by side from 0 on.
    """
    tokens = staged(tokenized(docs, tokenizer, capacity, with_ids), "tokens")
    # At most ``capacity`` rows.
    counts = {r["rest"]: r["n"] for r in tokens.groupBy("rest").agg(F.count("*").alias("n")).collect()}
    counts.pop(0, None)
    table, n_packed = slots(counts, capacity, least)

    def cut(parts):
        for part in parts:
            yield from batches(_PIECES, _pieces(part, table, n_packed, capacity, with_ids), lambda r: 70 + len(r[-1] or b""))

    columns = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in _PIECES)
    pieces = _placed(tokens, capacity).mapInArrow(cut, columns)
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """The sequences themselves from pieces with their ids: ``sequence_id``,
    ``ids`` (array of int, padded to ``capacity`` unless their number is a power
    of two), ``used`` (ids before the padding) and ``doc_ids``, ``starts``, the
    documents in it and where they begin. A group has ``capacity`` pieces at most."""
    schema = "sequence_id long, ids array<int>, used int, doc_ids array<long>, starts array<int>"
    out = pa.schema(
        [
            ("sequence_id", pa.int64()),
            ("ids", pa.list_(pa.int32())),
            ("used", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())),
            ("starts", pa.list_(pa.int32())),
        ]
    )

    def join(parts):
        for part in parts:

            def rows(part=part):
                for number, members in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    members = members.as_py()
                    ids = np.frombuffer(b"".join(m["ids"] for m in members), "<u4").astype(np.int32)
                    used = len(ids)
                    if used & (used - 1):
                        ids = np.append(ids, np.full(capacity - used, pad_id, np.int32))
                    yield number, ids, used, [m["doc_id"] for m in members], [m["offset"] for m in members]

            yield from batches(out, rows(), lambda r: 4 * len(r[1]))

    member = F.struct(F.col("offset").cast("int").alias("offset"), "doc_id", "ids")
    groups = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return groups.mapInArrow(join, schema)
