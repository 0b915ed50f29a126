"""Byte-level BPE encoding and decoding through an index of pair occurrences.

A task cuts its texts into words and keeps each distinct word once. All of them
lie side by side as byte symbols; an index maps each mergeable pair to every
position where it occurs. The ranks that occur are applied in ascending order:
one rank merges all of its positions at once, and the pairs that the merges
make enter the lists of their own ranks. A merge can only make pairs of later
ranks, which is checked when the vocabulary is read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches

# Fixed value: how byte-level tokenizers of this kind cut a text into words.
# White space is spelt out as the Unicode property.
_S = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?=$|{_S})|{_S}+"

# Bytes of distinct words that one pass over the ranks takes, and ranks a block.
PASS_BYTES = 2 << 20
BLOCK = 512
# Distinct words that a task remembers between runs, and characters of text of a run.
REMEMBERED = 150_000
RUN = 2 << 20
NEVER = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: printable
    bytes for themselves, the others for code points from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of public tokenizers."""

    def __init__(self, raw: bytes):
        data = json.loads(raw)
        model = data["model"]
        ids: dict[str, int] = model["vocab"]
        odd = [t for t in data.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if odd or data.get("normalizer") or model.get("byte_fallback") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level vocabularies can be read")
        letters = byte_letters()
        self.bytes_ids = np.array([ids[c] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        born = np.full(max(ids.values()) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        ranks = np.arange(len(merges))
        if (born[self.left] >= ranks).any() or (born[self.right] >= ranks).any():
            raise ValueError("a merge comes before its parts")
        self.width = len(born)
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.first = self.rank(
            np.repeat(self.bytes_ids, 256).astype(np.int64), np.tile(self.bytes_ids, 256).astype(np.int64)
        ).reshape(256, 256)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        value = {c: b for b, c in enumerate(letters)}
        self.text = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t, i in ids.items()}
        for t, i in self.special.items():
            self.text[i] = bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        self.words = regex.compile(PATTERN)
        self.wide = regex.compile(rf" (?:{_S}|$)|\0")
        longest = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NEVER`` for one that does not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NEVER)

    def chunks(self, text: str) -> Iterator[str | int]:
        """Runs of whole words of a text, and the id of each special token in it.

        A space before anything but white space always begins a word, so texts
        are cut there; one with wider gaps stays whole.
        """
        for part in self.split.split(text) if self.split else (text,):
            if part in self.special:
                yield self.special[part]
            elif part and self.wide.search(part):
                yield from self.words.findall(part)
            elif part:
                yield from part.replace(" ", "\0 ").lstrip("\0").split("\0")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        text = self.text
        return b"".join([text.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``words`` in a row, and how many each word has. No word may be empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    ends = np.cumsum(size)
    sym = np.append(vocab.bytes_ids[data], np.int32(-1))
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n
    before[ends - size] = -1
    rank = np.full(n + 1, NEVER, np.int32)
    if n > 1:
        rank[: n - 1] = vocab.first[data[:-1], data[1:]]
    rank[ends - 1] = NEVER
    alive = np.ones(n + 1, bool)
    alive[n] = False

    # Positions of all later blocks of ranks wait in ``later``; those of the
    # block at work are in ``lists`` by rank, and ``active`` has its ranks.
    spots = np.flatnonzero(rank != NEVER).astype(np.int32)
    later = [(rank[spots], spots)]
    for low in range(0, len(vocab.made), BLOCK):
        ranks = np.concatenate([r for r, _ in later])
        spots = np.concatenate([p for _, p in later])
        if not len(ranks):
            break
        now = ranks < low + BLOCK
        later = [(ranks[~now], spots[~now])]
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        _enter(lists, active, ranks[now], spots[now])
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if vocab.left[r] == vocab.right[r]:
                at = _apart(np.sort(at), after)
            gone = after[at]
            beyond = after[gone]
            sym[at] = vocab.made[r]
            rank[gone] = NEVER
            alive[gone] = False
            after[at] = beyond
            before[beyond] = at
            prior = before[at]
            changed = np.concatenate([at, prior[prior >= 0]])
            new = vocab.rank(sym[changed].astype(np.int64), sym[after[changed]].astype(np.int64))
            rank[changed] = new
            soon = new < low + BLOCK
            if soon.any():
                _enter(lists, active, new[soon], changed[soon])
            rest = (new != NEVER) & ~soon
            if rest.any():
                later.append((new[rest], changed[rest]))
    counts = np.add.reduceat(alive[:n], ends - size, dtype=np.int64) if n else size
    return sym[:n][alive[:n]], counts


def _enter(lists: dict[int, list[np.ndarray]], active: list[int], ranks: np.ndarray, spots: np.ndarray) -> None:
    """Put positions into the lists of their ranks."""
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, spots = ranks[order], spots[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(spots, cuts), strict=True):
        if r not in lists:
            lists[r] = [p]
            heapq.heappush(active, r)
        else:
            lists[r].append(p)


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a doubled symbol, from the left every other one."""
    out, taken = [], -1
    for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
        if p != taken:
            out.append(p)
            taken = q
    return np.array(out, np.int32)


class Encoder:
    """Encodes many texts, each distinct word once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str | int, int] = {}
        self.flat, self.counts, self.spelt = np.zeros(0, np.int32), np.zeros(0, np.int64), []

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """The ids of each text, and the same as decimals joined by commas."""
        if len(self.index) > REMEMBERED:
            self._clear()
        index, known = self.index, []
        for text in texts:
            chunks, found = self.vocab.chunks(text), []
            while some := list(islice(chunks, 500_000)):  # a very long text in runs
                found.append(np.fromiter([index.setdefault(p, len(index)) for p in some], np.int32, len(some)))
            known.append(np.concatenate(found) if found else np.zeros(0, np.int32))
        self._learn()
        starts = np.cumsum(self.counts) - self.counts
        spelt = self.spelt
        for words in known:
            yield _gather(self.flat, starts, self.counts, words), ",".join([spelt[w] for w in words.tolist()])

    def _learn(self) -> None:
        """Encode the chunks that came since the last time."""
        new = list(islice(self.index, len(self.spelt), None))
        flat, counts = [self.flat], [self.counts]
        while new:
            take, size = 0, 0
            while take < len(new) and size < PASS_BYTES:
                size += len(new[take]) if isinstance(new[take], str) else 1
                take += 1
            some, new = new[:take], new[take:]
            ids, n = self._encode(some)
            flat.append(ids)
            counts.append(n)
            text = list(map(str, ids.tolist()))
            places = np.cumsum(n) - n
            self.spelt += [",".join(text[a : a + c]) for a, c in zip(places.tolist(), n.tolist(), strict=True)]
        self.flat, self.counts = np.concatenate(flat), np.concatenate(counts)

    def _encode(self, chunks: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        words: dict[str, int] = {}
        held, per = [], []
        for chunk in chunks:
            if isinstance(chunk, str):
                inside = self.vocab.words.findall(chunk)
                held += [words.setdefault(w, len(words)) for w in inside]
                per.append(len(inside))
            else:
                held.append(-1 - chunk)
                per.append(1)
        ids, n = encode_words(self.vocab, [w.encode() for w in words])
        # Special tokens follow the words, each as a word of one id.
        held = np.array(held, np.int64)
        special = np.unique(-1 - held[held < 0])
        held[held < 0] = len(words) + np.searchsorted(special, -1 - held[held < 0])
        ids = np.concatenate([ids, special.astype(np.int32)])
        n = np.concatenate([n, np.ones(len(special), np.int64)])
        per = np.array(per, np.int64)
        sizes = np.add.reduceat(n[held], np.cumsum(per) - per)
        return _gather(ids, np.cumsum(n) - n, n, held), sizes


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, one after the other."""
    size = counts[which]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _rows(raw: bytes, parts) -> Iterator[tuple]:
    """(place in its batch, batch, (ids, spelt ids)) of each row; the text is the last column."""
    encoder = Encoder(vocabulary(raw))
    for part in parts:
        column, first, texts, size = part.column(part.num_columns - 1), 0, [], 0
        for k in range(part.num_rows):
            texts.append(column[k].as_py() or "")
            size += len(texts[-1])
            if size >= RUN or k + 1 == part.num_rows:
                yield from zip(range(first, k + 1), [part] * len(texts), encoder.encode(texts), strict=True)
                first, texts, size = k + 1, [], 0


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas)
    and ``decoded_sha256`` (the text that the ids decode to) of every row.

    ``path`` names a vocabulary file, read by the driver. A null text counts as
    empty and has no ids. The string of a special token in a text is that
    token. Rows that repeat are rows of their own, ids may be null, other
    columns are not looked at, and an empty table gives an empty table.
    """
    raw = _read(path)

    def digests(parts):
        vocab = vocabulary(raw)

        def rows():
            for k, part, (ids, spelt) in _rows(raw, parts):
                yield (
                    part.column(0)[k].as_py(),
                    len(ids),
                    hashlib.sha256(spelt.encode()).hexdigest(),
                    hashlib.sha256(vocab.decode(ids.tolist()).encode()).hexdigest(),
                )

        yield from batches(_DIGEST, rows())

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row of ``docs``."""
    raw = _read(path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(parts):
        rows = ((part.column(0)[k].as_py(), ids) for k, part, (ids, _) in _rows(raw, parts))
        yield from batches(schema, rows, lambda r: 4 * len(r[1]))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""
    raw = _read(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decode(parts):
        vocab = vocabulary(raw)
        rows = (
            (i, vocab.decode(ids or []))
            for part in parts
            for i, ids in zip(part.column(0).to_pylist(), (x.as_py() for x in part.column(1)), strict=True)
        )
        yield from batches(schema, rows, lambda r: len(r[1]))

    return encodings.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
