"""Periodic runs of words, by maximal pairs from the LCP-interval tree.

A run is a stretch of words with smallest period ``q`` that is at least
``times`` periods and ``shortest`` words long and that no neighbouring word
extends. Two places ``q`` apart that are followed by the same ``l`` words, with
different words before them and after those, are a maximal pair; if ``l`` is at
least ``(times - 1) * q``, the pair covers one run, first word to last, so
nothing has to be extended.

A batch of documents is one row of word numbers with a separator of its own
after each document. Only words that begin a repeated stretch of ``depth``
words can begin such a pair; their suffixes are sorted by prefix doubling, and
the LCP-interval tree over them is walked from the bottom. An interval has the
list of its places in ascending order, each with its class, the word to its
left. Where the list of a child enters that of its parent, each place meets its
neighbours from the other children: their common prefix is exactly the depth of
the interval, and the pair is maximal if the classes differ. Neighbours are
enough: a place between the two of a pair so close together would give the
stretch a smaller period. The shorter list always enters the longer one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches

Words = list[bytes]
Run = tuple[int, int, int]

# Words and bytes of text that are worked on together.
BATCH_WORDS = 200_000
BATCH_BYTES = 4 << 20
# Odd factors that mix word numbers.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def least_depth(shortest: int, times: int) -> int:
    """The fewest words that the two places of any pair have in common."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def _repeated(sym: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next ``depth`` words occur elsewhere in their document; by a
    hash, so there may be a few more."""
    n = len(sym) - depth + 1
    if n < 2:
        return np.zeros(0, np.int64)
    word = sym.astype(np.uint64) * _MIX[0]
    word ^= word >> np.uint64(29)
    mixed = doc[:n].astype(np.uint64)
    for k in range(depth):
        mixed = mixed * _MIX[1] + word[k : k + n]
    order = np.argsort(mixed)
    mixed = mixed[order]
    same = mixed[1:] == mixed[:-1]
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.flatnonzero(found)


def _heads(new: np.ndarray) -> np.ndarray:
    """For each element the index of the last element at which a group began."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _suffixes(sym: np.ndarray, doc: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` with those of equal beginnings side by side, and how
    many words each has in common with the one before (right from ``depth`` on)."""
    at = np.union1d(at, at + depth)  # what may follow a repeated stretch has to be in order too
    keys = [doc[at], *(sym[at + k] for k in range(depth))]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    places = at[order]
    # Any other place has a rank of its own, beyond all these.
    rank = np.arange(len(at), len(at) + len(sym))
    rank[places] = _heads(new)
    size, levels = depth, [(depth, rank.copy())]
    while True:
        ranks = rank[places]
        alone = np.bincount(ranks, minlength=len(ranks))[ranks] == 1
        rest = np.flatnonzero(~alone)
        if not len(rest):
            break
        group, p = ranks[rest], places[rest]
        beyond = rank[p + size]
        order = np.lexsort((beyond, group))
        p, beyond = p[order], beyond[order]
        new = np.ones(len(rest), bool)
        new[1:] = (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])
        places[rest] = p
        rank[p] = rest[_heads(new)]
        size *= 2
        levels.append((size, rank.copy()))
    a, b = places[:-1], places[1:]
    common = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        common += size * (rank[a + common] == rank[b + common])
    more = common >= depth
    for _ in range(depth - 1):
        more = more & (sym[a + common * more] == sym[b + common * more])
        common += more
    return places, common


def _pairs(places: list[int], common: list[int], left: list[int], depth: int, shortest: int, times: int) -> list[Run]:
    """The runs as (first place, length, period), from the LCP-interval tree."""
    found: list[Run] = []
    need = times - 1

    def pair(i: int, j: int, deep: int) -> None:
        if (j - i) * need <= deep and deep + j - i >= shortest and left[i] != left[j]:
            found.append((i, deep + j - i, j - i))

    def merged(deep: int, one: list[int], other: list[int]) -> list[int]:
        if len(one) < len(other):
            one, other = other, one
        last, spot = None, 0
        for k, x in enumerate(other):
            spot = bisect_left(one, x, spot)
            if spot and one[spot - 1] != last:
                pair(one[spot - 1], x, deep)
            if spot < len(one) and (k + 1 == len(other) or other[k + 1] > one[spot]):
                pair(x, one[spot], deep)
            one.insert(spot, x)
            last = x
        return one

    open_: list[tuple[int, list[int]]] = []
    for k, deep in enumerate([*common, 0]):
        node = [places[k]]
        while open_ and open_[-1][0] > deep:
            below, list_ = open_.pop()
            node = merged(below, list_, node)
        if deep < depth:
            continue
        if open_ and open_[-1][0] == deep:
            open_[-1] = (deep, merged(deep, open_[-1][1], node))
        else:
            open_.append((deep, node))
    return found


def runs_of(documents: list[Words], shortest: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs (start, length, period) of each document, by start, then period.

    ``times`` is a whole number from 3 on: with fewer periods a pair need not
    lie side by side with no other place between.
    """
    if times < 3:
        raise ValueError("a run has at least 3 periods")
    depth = least_depth(shortest, times)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    size = np.fromiter(map(len, documents), np.int64, len(documents))
    starts = np.cumsum(size + 1) - size  # a separator before each document, and one at the end
    doc = np.repeat(np.arange(len(documents) + 1), np.append(size + 1, 1))
    sym = np.zeros(len(doc), np.int64)
    for words, start in zip(documents, starts.tolist(), strict=True):
        sym[start : start + len(words)] = list(map(number.__getitem__, words))
    separators = np.append(starts - 1, len(sym) - 1)
    sym[separators] = len(number) + np.arange(len(separators))
    # A place near the end reads into the separators, which occur once each.
    sym = np.append(sym, len(number) + len(separators) + np.arange(depth))
    doc = np.append(doc, np.full(depth, len(documents)))
    result: list[list[Run]] = [[] for _ in documents]
    at = _repeated(sym, doc, depth)
    if not len(at):
        return result
    places, common = _suffixes(sym, doc, at, depth)
    left = np.append(sym[-1], sym[:-1])
    found = _pairs(places.tolist(), common.tolist(), left.tolist(), depth, shortest, times)
    for i, length, period in sorted(found, key=lambda r: (r[0], r[2])):
        k = int(doc[i])
        result[k].append((i - int(starts[k]), length, period))
    return result


def kept_words(words: Words, runs: list[Run]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


Rewrite = Callable[[int | None, Words], Words]


def _documents(parts, rewrite: Rewrite | None) -> Iterator[list[tuple[int | None, Words]]]:
    """(doc_id, words) of all rows, in lists of bounded size."""
    held, words, size = [], 0, 0
    for part in parts:
        ids = part.column(0).to_pylist()
        for i, text in zip(ids, part.column(1), strict=True):
            data = text.as_py() or b""
            # Fixed rule: bytes.split() cuts at space and 0x09 to 0x0D.
            own = data.split()
            if rewrite:
                own = rewrite(i, own)
            held.append((i, own))
            words += len(own)
            size += len(data)
            if words >= BATCH_WORDS or size >= BATCH_BYTES or len(held) >= 20_000:
                yield held
                held, words, size = [], 0, 0
    if held:
        yield held


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def repetitions(docs: DataFrame, shortest: int = 6, times: int = 4, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``period`` of every run of every text.

    Words are the stretches without white space. ``rewrite`` (doc_id, words)
    gives the words to look at in place of those of the text. Null, empty and
    wordless texts have no runs; rows that repeat are rows of their own; other
    columns are not looked at; an empty table gives an empty table. A text has
    to fit into a task, of any length; texts are searched in batches.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])

    def search(parts):
        rows = (
            (i, *run)
            for held in _documents(parts, rewrite)
            for (i, _), runs in zip(held, runs_of([w for _, w in held], shortest, times), strict=True)
            for run in runs
        )
        yield from batches(schema, rows)

    return _slim(docs).mapInArrow(search, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, shortest: int = 6, times: int = 4) -> DataFrame:
    """``doc_id`` and ``text``: the words that no run repeats, joined by one
    space; texts without runs stay as they are, null included."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def search(parts):
        for part in parts:
            texts = iter(part.column(1))
            for held in _documents([part], None):
                found = runs_of([w for _, w in held], shortest, times)
                rows = (
                    (i, (b" ".join(kept_words(words, runs)) if runs else t).decode() if t is not None else None)
                    for (i, words), runs, t in zip(held, found, (next(texts).as_py() for _ in held), strict=True)
                )
                yield from batches(schema, rows, lambda r: len(r[1] or ""))

    return _slim(docs).mapInArrow(search, "doc_id long, text string")


_REPORT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def run_report(docs: DataFrame, shortest: int = 6, times: int = 4, rewrite: Rewrite | None = None) -> DataFrame:
    """One row a text: ``doc_id``, ``n_runs``, the run of greatest length (ties:
    smallest start, then period) as ``start``, ``length``, ``period`` and
    ``exponent_milli``, all null without runs, and digests of all runs
    (``start,length,period`` and a line feed each, by start, then period) and of
    the words that stay, joined by one space. See ``repetitions`` for the rest.
    """

    def report(parts):
        def rows():
            for held in _documents(parts, rewrite):
                for (i, words), runs in zip(held, runs_of([w for _, w in held], shortest, times), strict=True):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    spelt = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    stay = b" ".join(kept_words(words, runs))
                    yield (
                        i,
                        len(runs),
                        *(best or (None, None, None)),
                        1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(spelt.encode()).hexdigest(),
                        hashlib.sha256(stay).hexdigest(),
                    )

        yield from batches(_REPORT, rows())

    types = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _REPORT)
    return _slim(docs).mapInArrow(report, types)
