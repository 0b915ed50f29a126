"""Scores of texts by masked pseudo-likelihood under a bidirectional window network.

Every token of a document is predicted from the tokens on both sides of it with
the token itself masked out; the sum of the conditional log-probabilities is
the score. Tokens are words in lower case: the most frequent words of the whole
corpus have numbers of their own, all others share ``BUCKETS`` numbers by hash.
The network embeds the window, has one hidden layer, and gives a number's
probability in two steps: its class of numbers of like frequency, then the
number inside the class. A word in a bucket takes a third step, its share of
the bucket, from a table of the counts of all words, which is joined by word
and grows with the corpus. All words that the corpus does not have share one
count of their bucket.

Everything is gathered from all documents: words are counted over all of them,
and each shard trains a copy of the network, by backpropagation in numpy, on
every position of each of its documents, once. A document's shard, and its
place there, come from hashes of its text and id, and the number of shards from
the number of words, so the scores do not depend on how the input is split. The
copies are averaged by the number of tokens they saw, in two levels, so the
driver gets few of them.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged

SIDE = 32  # classes, and numbers in a class
NUMBERS = SIDE * SIDE
BUCKETS = 256
REACH = 3  # tokens on each side
EMBED, HIDDEN = 16, 32
BATCH = 8192
RATE = 0.02
# Words of a shard. Words that are one of so many, at most as many, have shares that
# tasks know; those of all others are joined.
SHARD_WORDS = 4_000_000
COMMON = 1_000_000
FIRST_BUCKET = NUMBERS - BUCKETS
RARE = NUMBERS  # the bit above a number
# Shares of buckets are summed in whole numbers of 2^-26, so that the order of adding is all the same.
FINE = 1 << 26
# Tokens that are scored at once, those of a step that the processor's caches hold, and
# bytes of texts that are cut into words at once.
RUN = 65_536
STEP = 9216
PIECE = 12 << 20


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _pieces(part: pa.RecordBatch, texts: int):
    """Slices of a batch whose column ``texts`` has about ``PIECE`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(part.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
        yield part.slice(a, b - a)


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The `words` of some texts, one after another, as places in a list of
    different words; that list; and how many words there are up to the start
    of each text, and in all."""
    # Only the bytes of ASCII letters and white space are looked at, so texts need not be valid UTF-8.
    # They are copied, since `ascii_lower` wants the first to begin at the first byte.
    text = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()), b"")]).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    each = split.flatten().dictionary_encode()
    codes, ends = each.indices.to_numpy(), split.offsets.to_numpy()
    # White space before or after a text leaves an empty word.
    empty = pc.index(each.dictionary, pa.scalar("", each.dictionary.type)).as_py()
    if empty >= 0:
        full = codes != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return codes, each.dictionary.view(pa.large_binary()), ends


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all documents; each task counts those of a piece first."""

    def count(parts):
        for part in parts:
            for piece in _pieces(part, 0):
                codes, found, _ = coded(piece.column(0))
                n = np.bincount(codes, minlength=len(found))
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([found.take(pa.array(held)).cast(pa.binary()), pa.array(n[held])], ["word", "n"])

    local = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return local.groupBy("word").agg(F.sum("n").alias("n"))


class Numbering:
    """Numbers of words: the frequent ones first, then the buckets of the rest."""

    def __init__(self, frequent: list[bytes]):
        self.own = {w: k for k, w in enumerate(frequent)}

    def __getitem__(self, word: bytes) -> int:
        found = self.own.get(word)
        return FIRST_BUCKET + zlib.crc32(word) % BUCKETS if found is None else found


class Known:
    """What is known of words, each in one whole number: its number, ``RARE`` if
    its share is not known, and minus its log-share times ``FINE`` above these."""

    def __init__(self, numbering: Numbering, shares: dict[bytes, int] | None = None):
        shares = dict.fromkeys(numbering.own, 0) | (shares or {})
        self.held = {word: numbering[word] - share * 2 * RARE for word, share in shares.items()}

    def told(self, found: pa.Array) -> np.ndarray:
        """Of each word of a list; those not held are in buckets, as `Numbering` has it."""
        each = found.to_numpy(zero_copy_only=False)
        told = np.fromiter(map(self.held.get, each, repeat(-1)), np.int64, len(each))
        others = np.flatnonzero(told < 0)
        told[others] = np.fromiter(map(zlib.crc32, each[others]), np.int64, len(others)) % BUCKETS + FIRST_BUCKET + RARE
        return told


class Window:
    """The network: embeddings of 2 * REACH neighbours, a hidden layer, two softmaxes."""

    def __init__(self, shares: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        classes = shares.reshape(SIDE, SIDE)
        self.weights = [
            normal(0.3, NUMBERS + 1, EMBED),  # the last row stands for the edge of a document
            normal((2 * REACH * EMBED) ** -0.5, 2 * REACH * EMBED, HIDDEN),
            np.zeros(HIDDEN, np.float32),
            normal(0.1, HIDDEN, SIDE),
            np.log(classes.sum(axis=1)).astype(np.float32),
            normal(0.1, SIDE, HIDDEN, SIDE),
            np.log(classes / classes.sum(axis=1, keepdims=True)).astype(np.float32),
        ]

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = np.take(self.weights[0], context.reshape(-1), axis=0, mode="clip").reshape(len(context), -1)
        hidden = given @ self.weights[1]
        hidden += self.weights[2]
        # tanh by way of the exponential, which numpy has in fast form.
        np.clip(hidden, -20, 20, out=hidden)
        hidden *= -2
        np.exp(hidden, out=hidden)
        hidden += 1
        np.divide(2, hidden, out=hidden)
        hidden -= 1
        return given, hidden

    def _inside(self, hidden: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Logits inside the class of each row, rows being in the order of their
        classes, and (class, first row, end) of each class."""
        cuts = np.searchsorted(cls, np.arange(SIDE + 1)).tolist()
        parts = [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        logits = np.empty((len(cls), SIDE), hidden.dtype)
        for c, a, b in parts:
            np.matmul(hidden[a:b], self.weights[5][c], out=logits[a:b])
            logits[a:b] += self.weights[6][c]
        return logits, parts

    def log_chance(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        order = _by_class(target)
        cls, own = np.divmod(target[order], SIDE)
        steps = _steps(len(order))
        hidden = np.concatenate([self._hidden(np.take(context, order[k], axis=0))[1] for k in steps])
        inside = self._inside(hidden, cls)[0]
        found = np.empty(len(order), hidden.dtype)
        for k in steps:
            found[k] = _log_softmax_at(hidden[k] @ self.weights[3] + self.weights[4], cls[k])
            found[k] += _log_softmax_at(inside[k], own[k])
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        order = _by_class(target)
        context, target = np.take(context, order, axis=0), target[order]
        given, hidden = self._hidden(context)
        cls, own = np.divmod(target, SIDE)
        grads = [np.zeros_like(w) for w in self.weights]
        rows = np.arange(len(cls))
        d_class = _softmax(hidden @ self.weights[3] + self.weights[4])
        d_class[rows, cls] -= 1
        grads[3], grads[4] = hidden.T @ d_class, d_class.sum(axis=0)
        d_hidden = d_class @ self.weights[3].T
        logits, parts = self._inside(hidden, cls)
        d = _softmax(logits)
        d[rows, own] -= 1
        for c, a, b in parts:
            grads[5][c], grads[6][c] = hidden[a:b].T @ d[a:b], d[a:b].sum(axis=0)
            d_hidden[a:b] += d[a:b] @ self.weights[5][c].T
        d_hidden *= 1 - hidden * hidden
        grads[1], grads[2] = given.T @ d_hidden, d_hidden.sum(axis=0)
        d_given = (d_hidden @ self.weights[1].T).reshape(-1, EMBED)
        flat = context.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        grads[0][ordered[first]] = np.add.reduceat(np.take(d_given, order, axis=0), first)
        return [g / len(target) for g in grads]


def _steps(n: int) -> list[slice]:
    """Steps of ``STEP`` rows, the last of less than twice as many. Products are
    rounded by tiles of rows; ``STEP`` is a multiple of the usual ones (2^10 * 9), and no
    step is so small that it has other ones."""
    starts = [*range(0, max(n - STEP + 1, 1), STEP)]
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _by_class(target: np.ndarray) -> np.ndarray:
    return np.argsort((target // SIDE).astype(np.uint8), kind="stable")


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place, and their sums by row. Logits so far out that
    their exponential has no place in a float are drawn in."""
    np.clip(logits, -80, 80, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def _softmax(logits: np.ndarray) -> np.ndarray:
    found, total = _exp(logits)
    found /= total[:, None]
    return found


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = np.clip(logits[np.arange(len(at)), at], -80, 80)
    return own - np.log(_exp(logits)[1])


_SIDES = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


def padded(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with edges between the documents, the places of the tokens,
    and the document of each."""
    edge = np.full(REACH, NUMBERS, np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    tokens = np.concatenate([edge, *(part for t in texts for part in (np.asarray(t, np.int32), edge))])
    return tokens, np.flatnonzero(tokens != NUMBERS), np.repeat(np.arange(len(texts)), size)


def _rare(codes: np.ndarray, found: pa.Array, rare: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """``words`` and ``counts`` of each text: its words at the places ``rare``."""
    owner = np.searchsorted(ends, rare, side="right") - 1
    pairs, n = np.unique(owner * len(found) + codes[rare], return_counts=True)
    upto = pa.array(np.searchsorted(pairs, np.arange(len(ends)) * len(found)), pa.int32())
    word = found.take(pa.array(pairs % max(len(found), 1))).cast(pa.binary())
    lists = [pa.ListArray.from_arrays(upto, each) for each in (word, pa.array(n, pa.int64()))]
    return pa.RecordBatch.from_arrays(lists, ["words", "counts"])


def _runs(parts, numbers: Known, rare: bool = False):
    """(ids, numbers of the words, sum of the known shares, words whose share is
    not known and their counts) of some documents at a time; the last two only if ``rare``."""
    ids, texts, known, others, size = [], [], [], [], 0
    for piece in (piece for part in parts for piece in _pieces(part, 1)):
        codes, found, ends = coded(piece.column(1))
        told = numbers.told(found)[codes]
        own = (told & (NUMBERS - 1)).astype(np.int32)
        if rare:
            upto = np.concatenate([[0], np.cumsum(told // (2 * RARE))])[ends]
            known.extend((upto[:-1] - upto[1:]).tolist())
            left = _rare(codes, found, np.flatnonzero(told & RARE), ends)
        first, places = 0, ends.tolist()
        for k, i in enumerate(piece.column(0).to_pylist()):
            ids.append(i)
            texts.append(own[places[k] : places[k + 1]])
            size += places[k + 1] - places[k]
            if size >= RUN:
                others += [left.slice(first, k + 1 - first)] if rare else []
                yield ids, texts, known[: len(ids)], others
                first, known = k + 1, known[len(ids) :]
                ids, texts, others, size = [], [], [], 0
        others += [left.slice(first)] if rare else []
    if ids:
        yield ids, texts, known, others


class Adam:
    def __init__(self, weights: list[np.ndarray]):
        self.first, self.second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        self.step = 0

    def move(self, weights: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        a, b = 1 - 0.9**self.step, 1 - 0.99**self.step
        for w, g, m, v in zip(weights, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)


def _train(network: Window, runs, seed: int) -> int:
    """Train on every position of each document once; the number of them."""
    adam, seen = Adam(network.weights), 0
    rng = np.random.default_rng(seed)
    for _, texts, *_ in runs:
        tokens, places, _ = padded(texts)
        if not len(places):
            continue
        for some in np.array_split(rng.permutation(places), math.ceil(len(places) / BATCH)):
            rate = RATE / math.sqrt(1 + adam.step / 50)
            adam.move(network.weights, network.gradients(tokens[some[:, None] + _SIDES], tokens[some]), rate)
        seen += len(places)
    return seen


_COPY = pa.schema([("shard", pa.int32()), ("weights", pa.binary()), ("seen", pa.int64())])
_COPY_DDL = "shard int, weights binary, seen long"


def _averaged(parts):
    total, seen, first = None, 0, 0
    for part in parts:
        for shard, w, n in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
            own = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * n
            first = shard if total is None else first
            total, seen = own if total is None else total + own, seen + n
    if seen:
        yield pa.RecordBatch.from_pylist(
            [{"shard": first, "weights": (total / seen).astype(np.float32).tobytes(), "seen": seen}], schema=_COPY
        )


class Model:
    """A trained network with the numbers of its words, the counts of all words
    (``word``, ``n``), the sum of counts of each bucket, and the counts of the
    commonest words of the buckets."""

    def __init__(
        self, numbering: Numbering, network: Window, counts: DataFrame, totals: list[int], common: dict[bytes, int]
    ):
        self.numbering, self.network = numbering, network
        self.counts, self.totals, self.common = counts, totals, common

    def scorer(self) -> Scorer:
        """What tasks need of the model."""
        return Scorer(self.numbering, self.network)

    def score(self, texts: list[list[int]]) -> np.ndarray:
        return self.scorer().score(texts)

    def known(self) -> dict[bytes, int]:
        """The log-shares of the words that tasks know, times ``FINE``; a word
        with a number of its own has the whole of it."""
        found = dict.fromkeys(self.numbering.own, 0)
        for word, n in self.common.items():
            found[word] = round(math.log(n / (self.totals[zlib.crc32(word) % BUCKETS] + 1)) * FINE)
        return found

    def shares(self, rare: DataFrame) -> DataFrame:
        """``key`` and ``fine``, the sum of log-shares of the words of each key
        of ``rare`` (``key``, ``word``, ``c``) in their buckets, times ``FINE``."""
        totals = F.array(*[F.lit(t + 1) for t in self.totals])
        total = F.element_at(totals, (F.crc32("word") % BUCKETS + 1).cast("int"))
        share = F.log(F.coalesce("n", F.lit(1)) / total)
        # A word that is not found counts once, so those that occur once need not be there.
        told = rare.join(self.counts.where("n > 1"), "word", "left")
        return told.groupBy("key").agg(F.sum(F.round(share * FINE).cast("long") * F.col("c")).alias("fine"))


class Scorer:
    def __init__(self, numbering: Numbering, network: Window):
        self.numbering, self.network = numbering, network

    def score(self, texts: list[list[int]]) -> np.ndarray:
        """The sum of log-probabilities of the numbers of each document."""
        tokens, places, owner = padded(texts)
        total = np.zeros(len(texts))
        for k in range(0, len(places), RUN):
            some = places[k : k + RUN]
            chance = self.network.log_chance(tokens[some[:, None] + _SIDES], tokens[some])
            total += np.bincount(owner[k : k + RUN], chance, len(texts))
        return total


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def trained(docs: DataFrame) -> Model | None:
    """The model of all documents; None if they have no word."""
    counts = staged(word_counts(docs), "words")
    frequent = counts.orderBy(F.desc("n"), "word").limit(FIRST_BUCKET).collect()
    if not frequent:
        return None
    # No more than COMMON words can have that share of all.
    n_words = counts.agg(F.sum("n")).first()[0]
    common = {bytes(word): n for word, n in counts.where(F.col("n") * COMMON >= n_words).collect()}
    for word, _ in frequent:
        common.pop(bytes(word), None)
    numbering = Numbering([bytes(r[0]) for r in frequent])
    shares = np.ones(NUMBERS)
    shares[: len(frequent)] += [r[1] for r in frequent]
    every = counts.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    totals = [0] * BUCKETS
    for bucket, n in every.collect():
        totals[bucket] = n
    for word, n in frequent:
        totals[zlib.crc32(bytes(word)) % BUCKETS] -= n
    shares[FIRST_BUCKET:] += totals
    shares /= shares.sum()

    def train(parts):
        network, shard = Window(shares), TaskContext.get().partitionId()
        seen = _train(network, _runs(parts, Known(numbering)), shard)
        if seen:
            flat = np.concatenate([w.reshape(-1) for w in network.weights])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "weights": flat.tobytes(), "seen": seen}], schema=_COPY)

    shards = -(-n_words // SHARD_WORDS)
    # Copies of a text with ids of their own do not meet in one shard.
    dealt = _slim(docs).withColumn("place", F.xxhash64("text", "doc_id")).repartition(shards, "place")
    copies = dealt.sortWithinPartitions("place", "doc_id").select("doc_id", "text").mapInArrow(train, _COPY_DDL)
    groups = copies.repartition(1 + math.isqrt(shards), "shard").sortWithinPartitions("shard")
    parts = sorted(groups.mapInArrow(_averaged, _COPY_DDL).collect())
    network = Window(shares)
    if parts:
        seen = sum(r.seen for r in parts)
        flat = sum(np.frombuffer(r.weights, np.float32) * np.float64(r.seen / seen) for r in parts).astype(np.float32)
        at = 0
        for k, w in enumerate(network.weights):
            network.weights[k] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
    return Model(numbering, network, counts, totals, common)


_SCORED = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())]
    + [("known", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
)
_SCORED_DDL = (
    "key long, doc_id long, n_tokens long, log_prob double, known long, words array<binary>, counts array<long>"
)


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``log_prob`` (the
    sum over all tokens), ``mean_log_prob``.

    A text that is null, empty or all white space has no tokens, the sum 0 and
    a null mean. Whole texts are scored. Rows that repeat a text have the same
    score; ``doc_id`` may be null; other columns are not looked at, and an
    empty table gives an empty table.
    """
    model = model or trained(docs)
    scorer = model.scorer() if model else None
    known = Known(model.numbering, model.known()) if model else Known(Numbering([]))

    def score(parts):
        key = TaskContext.get().partitionId() << 40
        for ids, texts, told, rare in _runs(parts, known, True):
            totals = scorer.score(texts) if scorer else [0.0] * len(ids)
            row = [range(key, key + len(ids)), ids, list(map(len, texts)), totals, told]
            arrays = [pa.array(c, f.type) for c, f in zip(row, _SCORED)]
            others = pa.Table.from_batches(rare).combine_chunks().to_batches()
            yield pa.RecordBatch.from_arrays([*arrays, *others[0].columns], schema=_SCORED)
            key += len(ids)

    found = _slim(docs).mapInArrow(score, _SCORED_DDL)
    if model:
        # The key of a row holds from here on. Each rare word is a row for each document that has it.
        found = staged(found, "scores")
        pairs = F.explode(F.arrays_zip("words", "counts")).alias("pair")
        rare = found.select("key", pairs).select("key", F.col("pair.words").alias("word"), F.col("pair.counts").alias("c"))
        fine = model.shares(rare)
        found = found.select("key", "doc_id", "n_tokens", "log_prob", "known").join(fine, "key", "left")
        share = F.col("known") + F.coalesce("fine", F.lit(0))
        found = found.withColumn("log_prob", F.col("log_prob") + share / FINE)
    found = found.select("doc_id", "n_tokens", "log_prob")
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
